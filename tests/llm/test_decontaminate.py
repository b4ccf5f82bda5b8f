import re

import pytest

from llm_fixtures import make_docs  # noqa: F401

from ledgerlens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(n, len(b))
            if not k:
                continue
            for s in {tuple(b[j:j + k]) for j in range(len(b) - k + 1)}:
                for j in range(len(w) - k + 1):
                    if tuple(w[j:j + k]) == s:
                        hit.update(range(j, j + k))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(14))
ITEMS = [(1, LONG), (2, "Short ITEM"), (3, None), (4, "..."), (10, "short item"), (5, "É é été 3x"), (1, LONG)]
DOCS = [(1, f"pre {LONG.upper()} post"), (2, "a short,item. and short item"), (3, None), (4, ""), (5, "!!"),
        (6, " ".join(f"w{i}" for i in range(9))), (7, "é É ÉTÉ"), (8, "É é été 3X"), (2, "a short,item. and short item"),
        (9, "x " * 30000 + LONG), (None, "short item"), (2, "another text")]


@pytest.mark.parametrize("bound", [1 << 25, 0])
def test_matches_brute_force(spark, make_docs, bound):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS window", "1 AS at")
    got = D.contamination(make_docs(DOCS, extra=True), bench, broadcast_bytes=bound).collect()
    assert sorted([(r["doc"], r["n_words"], len(r["spans"]), list(r["items"])) for r in got], key=str) == brute(DOCS, ITEMS)


def test_removal(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(DOCS, extra=True)
    kept = D.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    bad = {(i, t) for (i, t), b in zip(DOCS, [brute([d], ITEMS)[0] for d in DOCS]) if b[2]}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((d for d in DOCS if d not in bad), key=str)
    clean = {(r["doc"], r["clean_text"]) for r in D.remove_spans(docs, bench).collect()}
    assert (1, "pre post") in clean and (2, "a and") in clean and (3, None) in clean and (4, "") in clean


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = make_docs(DOCS)
    assert D.contamination(none.limit(0), bench).count() == 0
    got = D.contamination(none, bench.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r["spans"] for r in got)
    assert D.remove_documents(none, bench.limit(0)).count() == len(DOCS)


def test_size_of_the_window_set_counts_its_items(spark):
    items = [(f"item-{i:06d}", "one window that very many items share") for i in range(3000)] + [("x", "another"), (None, "another")]
    windows = D.item_windows(spark.createDataFrame(items, "item_id string, text string"))
    sizes = {r["window"]: r["b"] for r in windows.select("window", D.row_bytes().alias("b")).collect()}
    assert sizes["one window that very many items share"] >= 3000 * 2 * len("item-000000")
    assert 0 < sizes["another"] < 200
