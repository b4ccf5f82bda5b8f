"""Edge cases and properties of the operators on tiny hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as ML
from ledgerlens.operators import nulls as N
from ledgerlens.operators import profile as P
from ledgerlens.operators import resample as R
from ledgerlens.plans import features as FT


def test_casts_never_fail(spark):
    df = spark.createDataFrame([("3.7",), ("",), ("abc",), ("3.0",), (None,), ("-2.9",)], "s string")
    got = [r[0] for r in df.select(C.to_int("s")).collect()]
    assert got == [3, None, None, 3, None, -2]
    got = [r[0] for r in df.select(C.to_float("s")).collect()]
    assert got[0] == pytest.approx(3.7) and got[1] is None and got[2] is None


def test_yes_no_exact(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), ("No",), (None,)], "f string")
    assert [r[0] for r in C.yes_no_binary(df, ["f"]).collect()] == [1, 0, 0, 0]


def test_code_suffix(spark):
    df = spark.createDataFrame([("entity_3",), ("unknown",), (None,), ("a_12_7",)], "c string")
    rows = df.select(C.code_suffix("c").alias("s"), C.code_number("c").alias("n")).collect()
    assert [r.s for r in rows] == ["3", "", None, "12"]
    assert [r.n for r in rows] == [3.0, None, None, 12.0]


def test_one_hot_null_is_zero(spark):
    df = spark.createDataFrame([(1,), (7,), (None,)], "t int")
    rows = C.one_hot(df, "t", (1, 7), "t").collect()
    assert [(r.t1, r.t7) for r in rows] == [(1, 0), (0, 1), (0, 0)]


def test_one_row_group_and_zero_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.1), ("b", 0.1), ("b", 0.1)], "k string, x double")
    out = P.profile(df, ["k"], ["x"], ["x"], alias="p")
    rows = {r.k: r for r in out.collect()}
    assert rows["a"].p_x_stv is None and rows["a"].p_x_kurtosis is None
    assert rows["b"].p_x_stv == 0.0 and rows["b"].p_x_kurtosis is None
    filled = {r.k: r for r in N.fill_zero(out).collect()}
    assert filled["a"].p_x_stv == 0.0 and filled["b"].p_x_kurtosis == 0.0
    assert rows["b"].p_x_count == 3


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    out = P.profile(df, ["k"], ["x"], None, alias="p", drop_all_null=True)
    assert "p_x_stv" not in out.columns and "p_x_kurtosis" not in out.columns
    assert "p_x_mean" in out.columns


def test_impute_by_split_uses_own_mean(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", None), ("train", 3.0),
                                ("test", 10.0), ("test", float("nan"))], "partition string, x double")
    out = N.impute_mean(df, ["x"], by="partition").collect()
    assert sorted((r.partition, r.x) for r in out) == [
        ("test", 10.0), ("test", 10.0), ("train", 1.0), ("train", 2.0), ("train", 3.0)]


def test_universe_union_types(spark):
    tr = spark.createDataFrame([("1", "period_1", 2)], "ID string, period string, attrition int")
    te = spark.createDataFrame([("2", "period_1")], "ID string, period string")
    u = FT.universe_union(tr, te)
    assert dict(u.dtypes)["attrition"] == "int"
    assert sorted((r.partition, r.attrition) for r in u.collect()) == [("test", None), ("train", 2)]


def _classes(spark):
    rows = [(f"id{i}", "p", 0) for i in range(50)] + [(f"id{i}", "p", 1) for i in range(50, 60)] \
        + [(f"id{i}", "p", 2) for i in range(60, 63)]
    return spark.createDataFrame(rows, "ID string, period string, y int")


def test_rebalance_sizes_exact(spark):
    df = _classes(spark)
    out = R.rebalance(df, "y", ("ID", "period"), 40)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 50, 1: 40, 2: 40}
    kept = out.where(F.col("y") == 0).select("ID").distinct().count()
    assert kept == 50


def test_rebalance_weighted(spark):
    df = _classes(spark)
    out = R.rebalance(df, "y", ("ID", "period"), 100, weights=[0.25, 0.125])
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 50, 1: 25, 2: 12}  # 12.5 rounds half to even
    with pytest.raises(ValueError):
        R.rebalance(df, "y", ("ID", "period"), 100, weights=[0.5])


def test_draws_stay_in_class_and_repeat(spark):
    df = _classes(spark)
    out = R.sample_with_replacement(df, "y", ("ID", "period"), 30)
    small = out.where(F.col("y") == 2)
    assert small.count() == 30 and small.select("ID").distinct().count() <= 3
    assert set(r.ID for r in small.collect()) <= {"id60", "id61", "id62"}


def test_draws_independent_of_partitioning(spark):
    df = _classes(spark)
    a = sorted(map(tuple, R.sample_with_replacement(df, "y", ("ID", "period"), 20).collect()))
    b = sorted(map(tuple, R.sample_with_replacement(df.repartition(7), "y", ("ID", "period"), 20).collect()))
    assert a == b


def test_rank_matches_global_row_number(spark):
    df = _classes(spark)
    two_level = R.rank_within_class(df, "y", ("ID", "period"), seed=1, bucket_bits=2)
    from pyspark.sql import Window
    w = Window.partitionBy("y").orderBy(R.row_hash(("ID", "period"), 1), "ID", "period")
    plain = df.withColumn("rank", F.row_number().over(w) - 1)
    assert sorted(map(tuple, two_level.collect())) == sorted(map(tuple, plain.collect()))


def test_hash_split_is_a_partition(spark):
    df = _classes(spark)
    out = R.hash_split(df, ("ID", "period"), 0.8, seed=3)
    assert out.count() == df.count()
    again = R.hash_split(df.repartition(5), ("ID", "period"), 0.8, seed=3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_macro_f1_and_precision(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 2), (2, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    # per class f1: c0 = 2*2/(3+3), c1 = 2*1/(2+3), c2 = 2*1/(2+1)
    want = (4 / 6 + 2 / 5 + 2 / 3) / 3
    got = M.macro_f1(df, "y", "p").first()
    assert got.macro_f1 == pytest.approx(want) and got.n_labels == 3
    prec = {r.label: r.precision for r in M.precision_by_label(df, "y", "p").collect()}
    assert prec[0] == pytest.approx(2 / 3) and prec[1] == pytest.approx(1 / 3) and prec[2] == 1.0


def test_two_stage_decision(spark):
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 0.0), (1.0, 4.0)], "b double, m double")
    got = [r[0] for r in df.select(C.two_stage_decision("b", "m")).collect()]
    assert got == [0, 1, 5]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(C.score_to_class("x")).collect()] == [0, 2, 2, 0]


def test_distinct_profile_bits_and_two_levels(spark):
    rows = [(None if i % 7 == 0 else i % 3, f"v{i}", i % 63 if i % 5 else None, i % 64, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, wide string, few int, over int, empty string").repartition(5)
    want = {}
    for g, *values in rows:
        sets = want.setdefault(g, [set() for _ in values])
        for s, v in zip(sets, values):
            s.update(() if v is None else (v,))
    cols = ["wide", "few", "over", "empty"]
    levels = P.code_levels(df, cols)
    assert sorted(levels) == ["empty", "few"] and len(levels["few"]) == 63 and levels["empty"] == []
    out = P.distinct_profile(df, ["g"], cols, "x")
    assert {r["g"]: [r[f"count_{c}_x"] for c in cols] for r in out.collect()} == {g: [len(s) for s in v] for g, v in want.items()}
    assert "collect_set" not in out._jdf.queryExecution().toString()
    known = P.distinct_profile(df, ["g"], ["few"], "x", levels={"few": levels["few"]})
    assert {r["g"]: r["count_few_x"] for r in known.collect()} == {g: len(v[1]) for g, v in want.items()}
    assert P.distinct_profile(df.limit(0), ["g"], cols, "x").count() == 0


def test_distinct_profile_of_a_hundred_thousand_values_in_one_group(spark):
    df = spark.range(300000).selectExpr("1 AS g", "id % 100000 AS v", "cast(id % 4 AS int) AS code")
    assert P.distinct_profile(df, ["g"], ["v", "code"], "x").first() == (1, 100000, 4)


def test_linear_stack_of_dependent_inputs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 200), rng.integers(0, 6, 200)
    x = np.stack([a, b, a, a + b, np.full(200, 3)], 1).astype(float)
    y = 0.5 * a - b + rng.normal(0, 0.1, 200)
    names = ["a", "b", "a2", "ab", "const"]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], names + ["y"])
    holes = df.limit(3).withColumn("a", F.lit(None).cast("double"))
    got = ML.fit_linear_stack(df.unionByName(holes), names, "y")
    c = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    assert np.allclose(got.coefficients, c, atol=1e-8) and np.isclose(got.intercept, y.mean() - x.mean(0) @ c)
    assert df.select(F.max(F.abs(got.predict() - (got.intercept + sum(F.lit(v) * F.col(n) for v, n in zip(c, names)))))).first()[0] < 1e-6
    assert holes.select(got.predict().alias("p")).where("p is not null").count() == 0
    with pytest.raises(ValueError):
        ML.fit_linear_stack(df.limit(0), names, "y")


def test_presence_is_one_bit_map_per_column(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "o'k"), ("b", None, None), ("b", 9.0, "y")], "k string, c float, t string")
    out = df.groupBy("k").agg(*P.presence("c", (1, 2, 3, 7), "c"), *P.presence("t", ("x", "o'k"), "t_"))
    assert {tuple(r) for r in out.collect()} == {("a", 1, 0, 1, 0, 1, 1), ("b", 0, 0, 0, 0, 0, 0)}
    assert {f.dataType.typeName() for f in out.schema.fields[1:]} == {"integer"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "max(" not in plan


def test_wide_partitions_follow_the_rows_and_are_set_back(spark):
    from ledgerlens.session import ROWS_PER_TASK, wide_partitions
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k, None) for k in keys]
    with pytest.raises(RuntimeError), wide_partitions(spark, 50 * ROWS_PER_TASK + 1):
        assert [spark.conf.get(k) for k in keys] == ["51", "8m"]
        raise RuntimeError
    with wide_partitions(spark, 1):
        assert spark.conf.get(keys[0]) == before[0]
    assert [spark.conf.get(k, None) for k in keys] == before


def test_profile_of_few_rows_a_key_is_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 900}", float(i % 7)) for i in range(1000)], "ID string, v double").coalesce(1)
    want = sorted(map(str, P.profile(df, ["ID"], ["v"], None, alias="p", drop_all_null=True).collect()))
    monkeypatch.setattr(P, "ROWS_PER_TASK", 100)
    seen, plain = [], P.aggregate
    monkeypatch.setattr(P, "aggregate", lambda d, *more: seen.append(d) or plain(d, *more))
    got = P.profile(df, ["ID"], ["v"], None, alias="p", drop_all_null=True, few_per_key=True)
    assert sorted(map(str, got.collect())) == want
    assert seen[0].rdd.getNumPartitions() == 10 and max(map(len, seen[0].rdd.glom().collect())) < 300
