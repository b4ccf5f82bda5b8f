import random
import time

import pytest

from ledgerlens.llm import htmltext as H


def text(page):
    return "\n".join(t for k, t in H.blocks(page) if k == H.MAIN)


@pytest.mark.parametrize("page, want", [
    ("<article><h1>A &amp; B</h1><p>x  y\n z<br>w<p>q</article><footer>f</footer>", "A & B\nx y z w\nq"),
    ("<nav>menu</nav><article><p>one</p><aside>side</aside><form>f</form><script>var t='</p>';</script><style>p{}</style>two</article>", "one\ntwo"),
    ("<article><p>a<b>b</b>c<!-- no --> d</p><div class='cookie-notice'>n</div><section id=comments><p>c</p></section></article>", "abc d"),
    ("<main><div class=\"ad\">x</div><p>&lt;b&gt; &#233;&nbsp;&eacute; &copy &unknown; &am</p></main>", "<b> é é © &unknown; &am"),
    ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ("<article><p>cut off <a href='x", "cut off"),
    ("<div></p></div></article><article>x</div>y</article>", "xy"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<article><article class='comment'>no</article><p>yes</article>", "yes"),
    ("<article><p title='a > b'>attr</p><p hidden>no</p><header>h</header></article>", "attr"),
    ("", ""), ("plain", ""), ("<<<>>><a", ""), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
])
def test_blocks(page, want):
    assert text(page) == want


def brute_unique(pages, run):
    """Loose tokens outside any run of ``run`` tokens that two distinct pages of the host share."""
    seen = {}
    for i, (pid, host, blocks) in enumerate(pages):
        tokens = [t for _, b in blocks for t in b.split()]
        for s in range(len(tokens) - run + 1):
            seen.setdefault((host, tuple(tokens[s:s + run])), set()).add(pid)
    out = []
    for pid, host, blocks in pages:
        tokens = [t for _, b in blocks for t in b.split()]
        hit = set()
        for s in range(len(tokens) - run + 1):
            if len(seen[host, tuple(tokens[s:s + run])]) > 1:
                hit.update(range(s, s + run))
        at, kept = 0, []
        for chrome, b in blocks:
            n = len(b.split())
            left = [tokens[i] for i in range(at, at + n) if i not in hit]
            at += n
            if left and not chrome:
                kept.append(" ".join(left))
        out.append((pid, "\n".join(kept)))
    return sorted(out)


def test_repeated_runs_of_a_host_go(spark):
    rng = random.Random(3)
    shared = [" ".join(f"s{k}t{i}" for i in range(rng.randrange(3, 15))) for k in range(6)]
    pages = []
    for pid in range(60):
        host = rng.choice(["a.com", "b.com"])
        blocks = [(False, rng.choice(shared)) if rng.random() < 0.5 else (rng.random() < 0.3, " ".join(f"u{pid}x{rng.randrange(9)}" for _ in range(5)))
                  for _ in range(6)]
        pages.append((pid, host, blocks))
    pages.append(pages[0])        # a repeated row is the same page
    rows = [(pid, f"http://{host}/{pid}", "<body>" + "".join(f"<{'nav' if c else 'div'}>{b}</{'nav' if c else 'div'}>" for c, b in blocks))
            for pid, host, blocks in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host", "2 AS key")
    got = sorted((r["page_id"], r["text"]) for r in H.extract(df, min_run=5).collect())
    assert got == brute_unique(pages, 5)


def test_nulls_copies_and_empty(spark):
    art = "<nav>m</nav><article><p>same words in every copy of this one article here</p></article>"
    rows = [(1, "http://a.com/1", art), (2, "http://a.com/2", art), (3, None, None), (None, "x", art), (5, "http://a.com/5", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    body = "same words in every copy of this one article here"
    assert got == {1: body, 2: body, 3: "", None: body, 5: ""}
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<div></p>", "<div></i>", "<li>", "<td><p>", "<span></div>"])
def test_a_megabyte_of_open_elements(piece):
    page = "<article><p>first</p>" + piece * (1_000_000 // len(piece)) + "last"
    began = time.process_time()
    got = H.blocks(page)
    assert time.process_time() - began < 10
    assert [t for _, t in got] in (["first", "last"], ["firstlast"])


def test_copies_without_a_container_keep_their_text(spark):
    body = "a plain article of quite some words that two addresses of one host both show to readers"
    menu = "home news sport weather travel food culture science contact about help"
    page = f"<body><div>{menu}</div><div>{body}</div><nav>%s</nav></body>"
    rows = [(1, "http://a.com/1", page % "one"), (2, "http://a.com/2", page % "two"), (3, "http://b.com/3", page % "x"),
            (4, "http://c.com/4", page % "y"), (5, "http://c.com/5", f"<body><div>{menu}</div><div>other words only</div></body>"),
            (6, "http://c.com/6", f"<article>own text</article><div>{menu}</div>"), (7, "http://c.com/7", f"<div>{menu}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    both = f"{menu}\n{body}"
    assert got == {1: both, 2: both, 3: both, 4: body, 5: "other words only", 6: "own text", 7: ""}


def test_suffix_array_is_sorted_and_its_neighbours_give_the_repeats(spark):
    import xxhash
    rng, run = random.Random(5), 3
    pages = [(i, i // 2, rng.choice(["a.com", "b.com"]),     # two rows of each page
              [(rng.choice([H.LOOSE, H.CHROME, H.MAIN]), " ".join(rng.choice("pqrs") for _ in range(rng.randrange(9)))) for _ in range(3)])
             for i in range(60)]
    parsed = spark.createDataFrame([(i, page, host, [k for k, _ in b], [t for _, t in b]) for i, page, host, b in pages],
                                   "_rid long, page long, host string, kinds array<int>, texts array<string>")
    want, owners = [], {}
    for i, page, host, b in pages:
        tokens = [t for k, x in b if k != H.MAIN for t in x.split()]
        for at in range(len(tokens) - run + 1):
            head = b"".join(xxhash.xxh3_64_intdigest(t).to_bytes(8, "big") for t in tokens[at:at + run])
            want.append((host, head, page, at, i))
            owners.setdefault((host, head), set()).add(page)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")       # runs lie across the ends of partitions
    try:
        array = H.suffix_array(parsed, run)
        got = [(r["host"], bytes(r["head"]), r["page"], r["at"], r["_rid"]) for r in array.collect()]
        repeated = {(r["host"], bytes(r["head"])) for r in H.repeated_runs(array, run).collect()}
        parts = array.rdd.getNumPartitions()
    finally:
        spark.conf.set(key, before)
    assert parts > 1 and got == sorted(want)
    assert repeated == {k for k, p in owners.items() if len(p) > 1} and len(repeated) < len(owners)
    lengths = H.common_prefixes([w[1] for w in got], run)
    assert [int(n) for n in lengths] == [next((j for j in range(run) if a[1][8 * j:8 * j + 8] != b[1][8 * j:8 * j + 8]), run)
                                         for a, b in zip(got, got[1:])]


def test_the_array_decides_on_loose_text_beside_a_container(spark):
    line = "read this site every day for news of all kinds and tell your friends"
    page = "<body><div>{0}</div><p>{1} leads</p><article><p>words of {1}</p></article><nav>menu</nav><p>{1} notes</p></body>"
    rows = [(i, f"http://a.com/{i}", page.format(line, f"page{i}")) for i in (1, 2)]
    rows += [(3, "http://b.com/3", page.format(line, "page3")), (4, "http://b.com/4", page.format(line, "page3"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df, min_run=5).collect()}
    own = {i: f"page{i} leads\nwords of page{i}\npage{i} notes" for i in (1, 2, 3)}
    assert got == {1: own[1], 2: own[2], 3: f"{line}\n{own[3]}", 4: f"{line}\n{own[3]}"}
