"""Edge cases of sampling, materialising, text sources, imputation, metrics and models."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as ML
from ledgerlens.operators import nulls as N
from ledgerlens.operators import profile as P
from ledgerlens.operators import resample as R
from ledgerlens.plans import features as FT
from ledgerlens.session import plain_constraints, shared_path, shared_root
from ledgerlens.sources.csv import read_csv, write_csv
from ledgerlens.sources.materialize import input_fingerprint, materialize_or_load


def test_split_fraction_is_exact(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    sides = R.hash_split(df, ["k"], 0.995).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in sides}
    assert 50 <= n["test"] <= 160 and n["train"] + n["test"] == 20000


def test_draws_with_null_keys_and_labels(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"k{i}", None if i % 7 == 0 else i % 2) for i in range(300)],
                               "k string, y int")
    drawn = R.sample_with_replacement(df, "y", ["k"], 1000)
    assert {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()} == {0: 1000, 1: 1000}
    assert R.class_histogram(df, "y").where("y is null").count() == 0
    assert R.rebalance(df, "y", ["k"], 50, weights=[1.0]).where("y is null").count() == 0


def test_one_row_class_with_many_draws(spark):
    df = spark.createDataFrame([("a", 0)] * 10 + [("b", 1)], "k string, y int")
    out = R.rebalance(df, "y", ["k"], 100_000)
    assert out.where("y = 1").count() == 100_000
    assert out.where("y = 1").select("draw").distinct().count() == 100_000


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_CLASSES", 5)
    with pytest.raises(ValueError):
        R.class_counts(spark.range(10).withColumnRenamed("id", "y"), "y")


def test_materialise_loads_and_rebuilds(spark):
    src = shared_path(spark, "materialise-input")
    spark.range(3).write.parquet(src)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(src)

    def run():
        return materialize_or_load(spark, build, "t", input_fingerprint(spark, [src], "v1")).count()

    assert run() == 3 and run() == 3 and len(built) == 1
    # another session names the same folder, so it finds the same table
    assert shared_root(spark.newSession()) == shared_root(spark)
    spark.range(7).write.mode("append").parquet(src)
    assert run() == 10 and len(built) == 2


def test_csv_columns_are_found_by_name(spark):
    path = shared_path(spark, "csv")
    write_csv(spark.createDataFrame([("p1", "x", "7"), ("p2", "y", "bad")], "period string, ID string, n string"), path)
    got = read_csv(spark, path, "ID string, period string, n int", sep="|")
    assert sorted(map(tuple, got.collect())) == [("x", "p1", 7), ("y", "p2", None)]


def test_impute_null_split_text_and_fit_on(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), ("b", "5"), ("b", "oops"), (None, "9"), (None, None)],
                               "s string, v string")
    got = sorted((r["s"] or "", r["v"]) for r in N.impute_mean(df, ["v"], by="s").collect())
    assert got == [("", 9.0), ("", 9.0), ("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 5.0)]
    fit = N.impute_mean(df, ["v"], by="s", fit_on="a")
    assert sorted(r["v"] for r in fit.collect()) == [1.0, 1.0, 1.0, 1.0, 5.0, 9.0]


def test_presence_of_text_levels(spark):
    df = spark.createDataFrame([(1, "red"), (1, "it's"), (2, None)], "k int, c string")
    got = df.groupBy("k").agg(*P.presence("c", ["red", "it's"], "is_")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (2, 0, 0)]


def test_null_label_is_no_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (None, 1), (1, None)], "y int, p int")
    assert M.macro_f1(df, "y", "p").first()["n_labels"] == 2
    recall = {r["label"]: r["recall"] for r in M.per_label_metrics(df, "y", "p").collect()}
    assert recall == {0: 1.0, 1: 0.5}


def test_setting_is_restored(spark):
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    with plain_constraints(spark):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == before


def small_matrix(spark, n=240):
    rows = [(f"c{i}", "p", float(i % 4), float((i * 7) % 5), i % 4, int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "ID string, period string, a double, b double, attrition bigint, binary_target int")


def test_two_stage_learns_and_never_sees_held_out_rows(spark):
    x = small_matrix(spark)
    mm = FT.ModelMatrix(R.hash_split(x, ["ID"], 0.8), x, ["a", "b"])
    train, held = FT.training_rows(mm, 60)
    assert train.join(held, "ID", "left_semi").count() == 0
    assert train.where("attrition = 1").count() in (60, mm.train.where("split = 'train' and attrition = 1").count())
    preset = ML.TwoStagePreset(max_depth=3, max_iter_binary=20, max_iter_multi=20, patience_binary=2, patience_multi=2, min_hessian=0.1)
    model = ML.fit_two_stage(train, held, ["a", "b"], preset=preset)
    got = model.transform(x).select("ID", "attrition", "target")
    assert got.where("attrition <> target").count() == 0
    scores = {r["stage"]: r["macro_f1"] for r in ML.evaluate_two_stage(model, held).collect()}
    assert scores["binary"] == scores["decision"] == 1.0
    path = shared_path(spark, "submission")
    ML.submit(got.select("ID", F.lit("p").alias("period"), "target"), path)
    assert read_csv(spark, path, "ID string, period string, target int").count() == 240


def months(prefix):
    return [f"{prefix}_month{k}" for k in range(1, 13)]


def test_feature_names_are_fixed():
    """The names of the wide table, spelled out here independently of the presets."""
    five = ("mean", "min", "max", "std", "sum")
    assert FT.output_columns(FT.BALANCES) == (
        ["mean_month_balances", "mean_type_balances", "mean_product_balances", "mean_entity_balances"]
        + [f"{s}_{c}_balances" for c in ("balance_amount", "days_default") for s in five]
        + ["type1", "type2", "type3", "type4", "type5", "type7"]
        + [f"product{k}" for k in range(1, 8)] + [f"entity{k}" for k in range(1, 6)] + months("bal"))
    assert FT.output_columns(FT.LIABILITIES) == (
        ["count_month_liabilities"] + [f"lbl_product_{k}_{s}" for s in ("mean", "std", "min", "max", "sum") for k in (1, 2)]
        + months("liab"))
    assert FT.output_columns(FT.MOVEMENTS) == (
        ["count_month_movements"]
        + [f"mvm_type_{k}_{s}" for s in ("mean", "std", "min", "max", "kurtosis", "sum") for k in range(1, 5)]
        + months("move"))
    assert FT.output_columns(FT.DIGITAL) == (
        [f"dig_{k}_{s}" for s in ("mean", "std", "min", "max", "kurt", "sum") for k in range(1, 12)] + months("digi"))
    assert FT.customer_columns() == (
        ["ID", "product_1", "product_2", "product_3", "product_4", "ofert_1", "ofert_2", "ofert_3", "age", "income",
         "payroll"] + [f"bureau_risk{k}" for k in range(1, 10)] + [f"type_job{k}" for k in range(1, 8)]
        + ["time_from_specialized1"])


def test_all_levels_and_means_of_the_training_part(spark):
    cust = spark.createDataFrame([("1", "3.0"), ("2", "")], "ID string, time_from_specialized string")
    for c in (*FT.CUSTOMER_FLAGS, *FT.CUSTOMER_FLOATS, "bureau_risk", "type_job"):
        cust = cust.withColumn(c, F.lit(None).cast("string"))
    got = {r["ID"]: r for r in FT.customer_features(cust, all_levels=True).collect()}
    assert [got["1"][f"time_from_specialized_{k}"] for k in range(6)] == [0, 0, 0, 1, 0, 0]
    assert sum(got["2"][f"time_from_specialized_{k}"] for k in range(6)) == 0

    rows = [(f"c{i}", "p", i % 2, "train", float(i) if i % 3 else None) for i in range(90)] + [("t", "p", None, "test", None),
                                                                                               ("u", "p", None, "test", 5.0)]
    wide = spark.createDataFrame(rows, "ID string, period string, attrition int, partition string, v double")
    own = FT.feature_matrix(wide)
    assert {r["ID"]: r["v"] for r in own.validation.collect()} == {"t": 5.0, "u": 5.0}
    mean = wide.where("partition = 'train'").agg(F.avg("v")).first()[0]
    assert {r["ID"]: r["v"] for r in FT.feature_matrix(wide, fit_on="train").validation.collect()}["t"] == mean
    part = FT.feature_matrix(wide, train_only=True)
    fit = part.train.where("split = 'train'")
    seen = [float(r["ID"][1:]) for r in fit.collect() if int(r["ID"][1:]) % 3]
    assert abs({r["ID"]: r["v"] for r in part.train.collect()}["c0"] - sum(seen) / len(seen)) < 1e-9


def test_model_matrix_takes_the_documented_draws():
    from ledgerlens.plans import catalog
    assert catalog.MATRIX_DRAWS == 220_000 and "range(0, 220000)" in catalog._matrix_sql()


def test_matrix_that_is_not_staged_has_the_same_rows(spark):
    inf = float("inf")
    rows = [(f"c{i}", "p", i % 2, "train", float(i) if i % 3 else None, (inf, -inf, None, 1.0)[i % 4]) for i in range(1, 60)]
    rows += [("n", "p", None, "train", 1.0, 1.0), ("t", "p", None, "test", 3.0, 2.0)]
    wide = spark.createDataFrame(rows, "ID string, period string, attrition int, partition string, v double, w double")
    once, again = FT.feature_matrix(wide), FT.feature_matrix(wide, staged=False)
    assert once.features == again.features == ["v", "w"] and once.train.dtypes == again.train.dtypes
    kept = sorted(map(tuple, once.train.collect()))
    assert kept == sorted(map(tuple, again.train.collect()))
    # the mean of w is no number, so its nulls stay incomplete and drop their rows
    assert {r[0] for r in kept} == {f"c{i}" for i in range(1, 60) if i % 4 != 2}
    assert again.validation.count() == 1 and "matrix-" not in " ".join(again.train.inputFiles())


def test_counted_draws_do_not_shuffle_wide_rows(spark):
    path = shared_path(spark, "wide-rows")
    spark.range(500).selectExpr("id", "id % 10 DIV 4 AS y", *[f"id + {i} AS c{i}" for i in range(5)]).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.rebalance_counted(spark.read.parquet(path), "y", ["id"], 40)
        assert got.agg(F.sum("times")).first()[0] == 200 + 2 * 40
        joins = [n for n in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in n]
        assert "BroadcastHashJoin" in joins[0] and "LeftOuter" in joins[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forest_rows_are_assembled_once(spark):
    from ledgerlens.plans import catalog
    mm, train, held_out, scoring = catalog.forest_rows(spark, "/root/testdata/sf0.001")
    _, plain, held, asked = catalog.counted_rows(spark, "/root/testdata/sf0.001")
    assert train.columns == ["ID", "period", "attrition", "times", "features"] and "forest-rows" in train.inputFiles()[0]
    got = {(r["ID"], r["period"]): (r["attrition"], r["times"], r["features"].toArray().tolist()) for r in train.collect()}
    assert got == {(r["ID"], r["period"]): (r["attrition"], r["times"], [r[c] for c in mm.features]) for r in plain.collect()}
    for a, b in ((held_out, held), (scoring, asked)):
        assert sorted(map(tuple, a.select("ID", "period", *mm.features[:9]).collect())) == sorted(
            map(tuple, b.select("ID", "period", *mm.features[:9]).collect()))
