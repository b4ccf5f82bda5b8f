"""Main text of HTML pages.

A page becomes blocks of text: inside a declared article container, chrome
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by
element name or by the words of class, id and role), or loose. Container blocks are
the article. On loose blocks, beside a container as on pages without one, the
host's suffix array decides: the loose and chrome tokens of a page form its stream,
the suffixes of all streams of a host are sorted, and where neighbours on
two distinct pages have a common prefix of ``MIN_RUN`` tokens the run is boilerplate and its
tokens are removed; unique runs of loose blocks are kept, chrome goes either way.

One Spark sort by host and suffix builds the suffix arrays of all hosts, so that one host may
own a third of all pages and still be spread over many tasks. Tokens are ordered by their
64-bit hash, suffixes by their first ``MIN_RUN`` tokens and then by page and place: a
longer common prefix changes no verdict, since its tokens are covered by the runs that start
inside it, and a suffix shorter than a run shares none. Common prefixes are taken between
neighbours of the sorted rows, and between the last and first rows of adjoining
partitions. Container text is left out, since articles themselves are
repeated within hosts (copies, quoted passages) and must stay whole.

Defined results: null, empty and markup-only pages have the empty text; broken
markup is read as browsers do for the cases that matter here (implied end
tags, stray end tags, unclosed elements, truncated pages), in time linear in
its open elements; repeated rows, and pages with loose text whose container and loose texts
are the same, are one page for the suffix array and each get their row, so copies
keep their text; a null url is a host of its own (the empty one); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, with_row_id
from .urlfilter import host_and_path

MIN_RUN = 8
BATCH_SUFFIXES = 50_000   # that a task hands over at a time

TAG = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRS = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
ATTR = re.compile(r"""(class|id|role|hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")

RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME_TAGS = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math", "button",
               "select", "menu", "dialog", "object", "canvas", "video", "audio", "label", "fieldset", "datalist"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense",
                "sponsor", "sponsors", "sponsored", "promo", "promos", "promotion", "banner", "cookie", "cookies",
                "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
                "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "sidebars", "rail",
                "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
                "pagination", "pager", "header", "masthead", "topbar", "footer", "copyright", "comment",
                "comments", "commentlist", "disqus", "replies", "share", "sharing", "social", "related",
                "contentinfo", "complementary", "search", "form"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "replies", "disqus"}
CONTAINERS = {"article", "main"}
BLOCKS = CONTAINERS | {"address", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt",
                       "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
                       "head", "header", "hgroup", "hr", "html", "li", "aside", "menu", "nav", "ol", "p", "pre",
                       "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag of these ends an open element of the listed names, looking up to the given ancestors.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
P_SCOPE = {"table", "td", "th", "button", "object"}

LOOSE, MAIN, CHROME = 0, 1, 2


def is_chrome(name: str, attrs: str) -> bool:
    if name in CHROME_TAGS:
        return True
    if name in ("body", "html", "main") or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    words = COMMENT_WORDS if name == "article" else CHROME_WORDS
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2]
        if key == "hidden" and name != "article" and value is None:
            return True
        if value and key != "hidden" and not words.isdisjoint(WORD.findall(value.lower())):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of every block with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []   # name, chrome, container
    places: dict[str, list[int]] = {}          # where in the stack each name is open
    keep: list[str] = []
    away: list[str] = []
    chrome = inside = 0

    def flush() -> None:
        for kind, parts in ((MAIN if inside else LOOSE, keep), (CHROME, away)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((kind, text))
                parts.clear()

    def text(piece: str) -> None:
        if piece:
            (away if chrome else keep).append(html_module.unescape(piece) if "&" in piece else piece)

    def pop_to(depth: int) -> None:
        nonlocal chrome, inside
        for name, was_chrome, was_container in stack[depth:]:
            if name in BLOCKS or was_chrome:
                flush()
                break
        for name, was_chrome, was_container in stack[depth:]:
            chrome -= was_chrome
            inside -= was_container
            places[name].pop()
        del stack[depth:]

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names, until) -> None:
        depth = last(names)
        if depth > last(until):
            pop_to(depth)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        if m[3] is None:
            if m[1] is None:                      # a comment
                stop = page.find("-->", m.end())
                at = end if stop < 0 else stop + 3
            else:                                 # a declaration
                stop = page.find(">", m.end())
                at = end if stop < 0 else stop + 1
            continue
        rest = ATTRS.match(page, m.end())
        if rest is None:
            stop = page.find(">", m.end())
            if stop < 0:                          # the page ends inside a tag
                break
            attrs, at = page[m.end():stop], stop + 1
        else:
            attrs, at = page[m.end():rest.end() - 1], rest.end()
        name = m[3].lower()
        if m[2]:
            depth = last((name,))
            if depth >= 0:
                pop_to(depth)
            elif name == "p":        # a stray </p> is an empty paragraph, other stray end tags are nothing
                flush()
            elif name == "br":
                text(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end if stop is None else stop.end()
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCKS:
            if name in CLOSES_P:
                close({"p"}, P_SCOPE)
            flush()
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in VOID:
            continue
        drop = is_chrome(name, attrs)
        if drop:
            flush()
        container = name in CONTAINERS and not drop and not chrome
        places.setdefault(name, []).append(len(stack))
        stack.append((name, drop, container))
        chrome += drop
        inside += container
    flush()
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The container text of every page, its blocks, and whether its text depends on the
    suffix array (some loose text). Such pages with equal container and loose blocks are
    one page to the repeat test; other pages keep only blocks outside the container."""
    import xxhash
    for b in batches:
        kinds, texts, main, undecided, keys = [], [], [], [], []
        for page, key in zip(b["html"], b["page"]):
            found = blocks(page) if isinstance(page, str) else []
            article = "\n".join([t for k, t in found if k == MAIN])
            undecided.append(any(k == LOOSE for k, _ in found))
            if undecided[-1]:
                loose = "\n".join([t for k, t in found if k == LOOSE])
                key = np.uint64(xxhash.xxh3_64_intdigest(f"{article}\0{loose}")).astype(np.int64)
                article = ""
            else:
                found = [(k, t) for k, t in found if k != MAIN]
            kinds.append([k for k, _ in found])
            texts.append([t for _, t in found])
            main.append(article)
            keys.append(key)
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "page": keys, "host": b["host"],
                            "text": main, "kinds": kinds, "texts": texts, "undecided": undecided})


def suffix_heads(tokens: list[str], run: int = MIN_RUN) -> np.ndarray:
    """The first ``run`` tokens of every suffix that long, as a row of big-endian hashes each."""
    import xxhash
    ids = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens)).astype(">u8")
    return np.lib.stride_tricks.sliding_window_view(ids, run) if len(ids) >= run else ids[:0].reshape(0, run)


def _suffixes(run: int):
    def rows(b: pd.DataFrame, held: list) -> pd.DataFrame:
        of = np.repeat([i for i, _, _ in held], [len(heads) for _, _, heads in held])
        raw, width = b"".join([heads.tobytes() for _, _, heads in held]), 8 * run
        return pd.DataFrame({"_rid": b["_rid"].to_numpy()[of], "page": b["page"].to_numpy()[of],
                             "host": b["host"].to_numpy()[of],
                             "at": np.concatenate([np.arange(at, at + len(heads)) for _, at, heads in held]),
                             "head": [raw[i:i + width] for i in range(0, len(raw), width)]})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, n = [], 0
            for i, (kinds, texts) in enumerate(zip(b["kinds"], b["texts"])):
                heads = suffix_heads([t for k, x in zip(kinds, texts) if k != MAIN for t in x.split()], run)
                for at in range(0, len(heads), BATCH_SUFFIXES):
                    held.append((i, at, heads[at:at + BATCH_SUFFIXES]))
                    n += len(held[-1][2])
                    if n >= BATCH_SUFFIXES:
                        yield rows(b, held)
                        held, n = [], 0
            if held:
                yield rows(b, held)
    return go


def suffixes(parsed: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """Every suffix of every page's stream: its place ``at`` and its first ``run`` tokens."""
    return parsed.select("_rid", "page", "host", "kinds", "texts").mapInPandas(
        _suffixes(run), "_rid long, page long, host string, at int, head binary")


def suffix_array(parsed: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """The sorted suffixes of all hosts, in one global order. Page, place and row break ties, so that
    a run that stands on every page is spread over tasks like any other."""
    return suffixes(parsed, run).orderBy("host", "head", "page", "at", "_rid")


def common_prefixes(heads: list[bytes], run: int = MIN_RUN) -> np.ndarray:
    """Tokens that each suffix but the first shares with the one before it, up to ``run``."""
    ids = np.frombuffer(b"".join(heads), np.uint64).reshape(-1, run)
    return np.cumprod(ids[1:] == ids[:-1], axis=1).sum(axis=1)


def _neighbours(run: int):
    """Suffixes that share a run with their neighbour on another page, one of each run and
    batch (edge 0), and the first and last suffix of the partition (edges 1 and 2)."""
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not len(b):
                continue
            if last is None:
                yield b[:1].assign(part=part, edge=1)
            else:
                b = pd.concat([last, b], ignore_index=True)
            host, page = b["host"].to_numpy(), b["page"].to_numpy()
            shared = (common_prefixes(b["head"], run) == run) & (host[1:] == host[:-1]) & (page[1:] != page[:-1])
            yield b[1:][shared].drop_duplicates(["host", "head"]).assign(part=part, edge=0)
            last = b[-1:]
        if last is not None:
            yield last.assign(part=part, edge=2)
    return go


def repeated_runs(array: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """(host, head) of the runs that two distinct pages of the host share, from neighbours in the suffix array."""
    found = stored(array.select("host", "head", "page").mapInPandas(
        _neighbours(run), "part int, edge int, host string, head binary, page long"), "suffix-neighbours")
    order = W.orderBy("part", "edge")     # two rows of each partition
    ends = found.where("edge > 0").select("host", "head", "page", *[F.lag(c).over(order).alias(f"_{c}")
                                                                    for c in ("host", "head", "page")])
    across = ends.where("host = _host and head = _head and page <> _page")
    return found.where("edge = 0").select("host", "head").unionByName(across.select("host", "head")).distinct()


def _unique_runs(run: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for kinds, parts, starts in zip(b["kinds"], b["texts"], b["starts"]):
                split = [[] if k == MAIN else p.split() for k, p in zip(kinds, parts)]
                covered = np.zeros(sum(map(len, split)) + 1, np.int64)
                for s in starts if starts is not None else ():
                    covered[s] += 1
                    covered[min(s + run, len(covered) - 1)] -= 1
                hit = np.cumsum(covered) > 0
                left, at = [], 0
                for kind, part, tokens in zip(kinds, parts, split):
                    if kind == MAIN:
                        left.append(part)
                    own = [t for t, c in zip(tokens, hit[at:at + len(tokens)]) if not c]
                    at += len(tokens)
                    if kind == LOOSE and own:
                        left.append(" ".join(own))
                texts.append("\n".join(left))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})
    return go


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_run: int = MIN_RUN) -> DataFrame:
    """page_id, url, text of every row of ``pages``."""
    host, _ = host_and_path(F.col(url_col))
    id_type = pages.schema[id_col].dataType
    # ids travel as text: pandas would turn whole numbers with a null among them into floats
    keyed = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"),
                         F.xxhash64(F.col(id_col), F.col(url_col)).alias("page"), host.alias("host"),
                         F.col(html_col).alias("html"))
    parsed = stored(with_row_id(keyed.mapInPandas(
        _parsed, "page_id string, url string, page long, host string, text string, kinds array<int>, "
                 "texts array<string>, undecided boolean")), "parsed-pages")
    decided = parsed.where("not undecided").select("page_id", "url", "text")
    repeated = repeated_runs(suffix_array(parsed, min_run), min_run)
    starts = (suffixes(parsed.where("undecided"), min_run).join(repeated, ["host", "head"])
              .groupBy("_rid").agg(F.collect_list("at").alias("starts")))
    rest = (parsed.where("undecided").select("_rid", "page_id", "url", "kinds", "texts").join(starts, "_rid", "left")
            .select("page_id", "url", "kinds", "texts", "starts")
            .mapInPandas(_unique_runs(min_run), "page_id string, url string, text string"))
    return decided.unionByName(rest).withColumn("page_id", F.col("page_id").cast(id_type))
