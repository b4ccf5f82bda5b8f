"""Curriculum mixing against a plain mix, document by document."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import curriculum

DOCS = "doc_id long, text string, source string, size string, place string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, sources above their limit held there, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        rest, open_ = total - sum(held.values()), sum(weight[s] for s in free)
        share = {s: weight[s] * rest / open_ for s in free} if free else {}
        above = [s for s in free if share[s] >= most * sizes[s]]
        if not above:
            return {**held, **share}
        held.update({s: most * sizes[s] for s in above})


def plain_mix(rows):
    size = lambda t: len((t or "").translate(dict.fromkeys(range(9, 14), " ")).replace(" ", "\n").split("\n")) \
        - (t or "").translate(dict.fromkeys(range(9, 14), " ")).replace(" ", "\n").split("\n").count("")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    out = []
    for s in sizes:
        own = sorted(((int(hashlib.md5(f"mix2020:{i}".encode()).hexdigest()[:15], 16), i, size(t)) for i, t, x in rows if x == s))
        at = 0
        for _, i, n in own:
            copies = 0
            if n:
                whole = int(targets[s] // sizes[s])
                copies = whole + (at + n / 2 < targets[s] - whole * sizes[s])
            out.append((i, n, sizes[s], round(targets[s], 6), n * copies))
            at += n
    return sorted(out)


def rows_of(mixed):
    return sorted((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["size"] * len(r["positions"]))
                  for r in mixed.collect())


CASES = {
    "one source is most of it": [(i, "w " * (i % 7 + 1), "big") for i in range(300)]
    + [(1000 + i, "a b c", s) for i, s in enumerate(["x", "y", None, "z"] * 3)],
    "nulls, empty and long texts": [(1, None, "a"), (2, "", "a"), (3, "x\t\x0by \n z", "b"), (4, "w " * 50_000, None), (5, " ", "e")],
    "only empty texts": [(1, None, "a"), (2, "", "b")],
    "one row": [(7, "a b", "s")],
}


@pytest.mark.parametrize("name", CASES)
def test_mix_is_the_plain_mix(spark, name):
    assert rows_of(curriculum.mix(docs_of(spark, CASES[name]))) == plain_mix(CASES[name])


def test_limits_and_reruns(spark):
    docs = docs_of(spark, CASES["one source is most of it"])
    got = curriculum.mix(docs).collect()
    assert [r.asDict() for r in curriculum.mix(docs).collect()] == [r.asDict() for r in got]
    assert max(len(r["positions"]) for r in got) == 3       # the small sources stop at their limit
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        taken = sum(r["size"] * len(r["positions"]) for r in own)
        assert taken <= 3 * own[0]["source_size"]
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_empty_table(spark):
    assert curriculum.mix(docs_of(spark, [])).collect() == []


def test_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 40 + [(2, "d", "s")] * 5 + [(3, "e f", "t")] * 3
    assert rows_of(curriculum.mix(docs_of(spark, rows))) == plain_mix(rows)


def test_copies_come_in_training_order(spark):
    got = curriculum.copies(curriculum.mix(docs_of(spark, CASES["one source is most of it"]))).collect()
    at = [r["position"] for r in got]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    seen = defaultdict(list)
    for r in got:
        seen[r["id"]].append(r["epoch"])
    assert all(e == list(range(len(e))) for e in seen.values())


@pytest.mark.parametrize("knots", curriculum.SCHEDULES)
def test_time_inverts_the_integral(spark, knots):
    shares = [i / 200 for i in range(201)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(shares)], "i int, x double").orderBy("i")
           .select(curriculum.time_of(F.col("x"), knots)).collect()]

    def integral(t, steps=20_000):
        def weight(x):
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                if x <= t1:
                    return w0 + (w1 - w0) * (x - t0) / (t1 - t0)
        return sum(weight(t * (k + 0.5) / steps) for k in range(steps)) * t / steps

    whole = integral(1.0)
    assert got == sorted(got)
    for x, t in list(zip(shares, got))[::20]:
        assert abs(integral(t) / whole - x) < 1e-4


def test_no_python_in_the_plan(spark):
    plan = curriculum.mix(docs_of(spark, CASES["one row"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
