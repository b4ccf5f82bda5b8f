from math import floor, isfinite

from pyspark.sql import functions as F

from ledgerlens.llm import topk

NAN = float("nan")


def brute(rows, k):
    v = [(i, [floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 5 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_matches_brute_force(spark):
    rows = [(i, [((i * j) % 7 - 3) / 4 for j in range(1, 9)]) for i in range(60)]
    rows += [(100, None), (105, [None, 1.0]), (110, [NAN]), (115, [float("inf")]), (120, []), (125, [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS w", "1 AS q", "2 AS id")
    for block in (7, 1000):
        got = topk.top_k(df, F.col("vec_id") % 5 == 0, 5, candidate_block=block, query_block=4)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_ties_few_candidates_and_empty(spark):
    rows = [(i, [1.0, 1.0]) for i in (5, 9, 2, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 5, 5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 7), (3, 9)]
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0
    assert topk.top_k(df, F.lit(False), 5).count() == 0


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    rows = [(5, [1e30, 1.0]), (1, [1e17, 1.0]), (2, [1e17, 2.0]), (3, [-1e17, 1.0]), (4, [-1e17, 2.0]), (6, [0.0, 1e12]),
            (7, [1e300, 0.0]), (8, [0.0, 3.5]), (9, [0.0, -0.5]), (11, [-1e300, 5.0]), (12, [1e17, 2.0]), (13, [2.0 ** 53 + 2, 1.0])]
    low, high = -2 ** 63, 2 ** 63 - 1
    weigh = {i: [int(x) * 256 if abs(x) >= 2 ** 52 else floor(256 * x) for x in e] for i, e in rows}
    want = sorted((-sum(x * y for x, y in zip(weigh[5], weigh[i])), i) for i in weigh if i != 5)
    want = [(r + 1, i, min(max(-s, low), high)) for r, (s, i) in enumerate(want)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (3, 1000):
        got = topk.top_k(df, F.col("vec_id") == 5, 20, candidate_block=block).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == want
    small = topk.top_k(df.where("vec_id in (8, 9)"), F.col("vec_id") == 8, 5).collect()
    assert [(r["vec_id"], r["score"]) for r in small] == [(9, 896 * -128)]


def test_order_of_scores_at_the_ends_of_a_long():
    scores = [-10 ** 40, -10 ** 20 - 1, -10 ** 20, -2 ** 63 - 1, -2 ** 63, -2 ** 63 + 1, 0, 2 ** 63 - 1, 2 ** 63, 10 ** 20, 10 ** 40]
    ends = [(min(max(s, -2 ** 63), 2 ** 63 - 1), topk._beyond(s)) for s in scores]
    assert ends == sorted(ends) and len(set(ends)) == len(ends)
