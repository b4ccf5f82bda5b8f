"""The filter audit against a plain run of every order."""

import re
from itertools import permutations

import pytest

from ledgerlens.llm import audit

DOCS = "doc_id long, text string, source string, part string, rid string, good string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "clash", "clash", "clash") for i, t, s in rows], DOCS)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_documents(docs, rated).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got}, len(got)


def fails_of(rows):
    out = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        smaller = any(j is not None and (i is None or j < i) for j, u, _ in rows if (u or "") == t)
        out.append({f for f, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)),
                                     ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
                                     ("D", bool(re.search(r"[#$%&*|]", t))), ("E", smaller)) if bad})
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails, out = fails_of(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                out[part, order, k + 1] = [
                    len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == f)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(60))
CASES = {
    "mixed": ([(i, t, s) for i, (t, s) in enumerate([
        (LONG, "a"), (LONG, "a"), (LONG, "b"), (LONG + " #", "a"), ("A B C", "a"), ("x " * 80, "b"), (None, "b"), ("", "c"),
        ("X " * 80 + "$", None), (LONG.upper(), None), ("é" * 5 + " " + LONG, "d"), (" \t\x0b" + LONG, "d"), ("x " * 200_000, "e")])],
        [(0, 1, 0), (1, 1, 1), (3, 0, 1), (4, 1, 1), (6, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]),
    "repeated rows, labels and ids": ([(1, LONG, "a"), (1, LONG, "a"), (2, LONG, "a"), (1, "x", "a"), (2, "x", ""), (3, "y|", None)],
                                      [(1, 0, 0), (1, 1, 0), (2, 1, 1), (2, 1, 1)]),
    "no labels": ([(1, "a", "s"), (2, "a", "s")], []),
    "null ids": ([(None, "a", "s"), (5, "a", "s"), (None, "b", "s")], [(5, 1, 1)]),
    "all copies": ([(i, LONG, "s") for i in range(40)], [(i, 1, 0) for i in range(0, 40, 3)]),
}


@pytest.mark.parametrize("name", CASES)
def test_audit_is_the_plain_run(spark, name):
    rows, labels = CASES[name]
    got, n = run(spark, rows, labels)
    want = plain(rows, labels)
    assert n == len(want) and got == want


def test_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == ({}, 0)
