"""Query catalog: every operator of the engine as a named query over a data
directory, and the matching SQL check.

``QUERIES[key](spark, sf_dir) -> DataFrame``; ``ORACLE[key]`` is DuckDB SQL
over the same parquet tables. Floating outputs are rounded to 4 decimals
on both sides with the same arithmetic (``for_check``/``oracle.rnd``) so
that summation order cannot flip a digit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import nulls as N
from ..operators import profile as P
from ..operators import resample as R
from ..session import plain_constraints, shared_path, wide_partitions
from ..sources import fixtures as X
from ..sources.csv import read_csv, write_csv
from ..sources.materialize import fingerprint, input_fingerprint, materialize_or_load, stage, staging_area
from ..sources.tables import Tables
from . import features as FT
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SEED = 2020
# Rebalancing weights of the minority classes (most frequent
# first) and the draw counts used with them.
WEIGHTS = (0.6563560972894752, 0.11811932988256248, 0.0959119496855346, 0.08249846941615184,
           0.04711415372627595)
WEIGHTED_DRAWS = 220000
UNIFORM_DRAWS = 30000
DRAWS_PER_CLASS = 1000
PREVIEW_ROWS = 5


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def for_check(df: DataFrame) -> DataFrame:
    """Round float/double columns to 4 decimals on the grid of ``oracle.rnd``."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.selectExpr(*[
        f"floor(CAST(`{c}` AS DOUBLE) * {O.ROUND_SCALE}D + {O.ROUND_CUT}D) / {O.ROUND_SCALE}D AS `{c}`"
        if c in floating else f"`{c}`" for c in df.columns])


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# ---------------------------------------------------------------- pipeline parts

def universe(t: Tables) -> DataFrame:
    return FT.universe_union(X.universe_train(t), X.universe_test(t))


def wide_table(t: Tables) -> DataFrame:
    feats = [FT.movement_features(X.movements(t)), FT.liability_features(X.liabilities(t)),
             FT.balance_features(X.balances(t)), FT.digital_features(X.digital(t))]
    return FT.feature_star_join(universe(t), feats, FT.customer_features(X.customers(t)))


WIDE_COLUMNS = (["ID", "period", "attrition", "partition"]
                + [c for _, _, p in O.FEATURE_TABLES for c in FT.output_columns(p)]
                + O.customer_feature_columns())
WIDE_SQL = O.with_views(O.WIDE_VIEWS, O.select_rounded(WIDE_COLUMNS, O.wide_floating(), "wide"),
                        O.wide_ctes())


# ---------------------------------------------------------------- sources and sinks

@query("csv_roundtrip", O.with_views(["universe_train"], "SELECT ID, period, attrition FROM universe_train"))
def q_csv_roundtrip(spark, sf_dir):
    path = shared_path(spark, "universe_train_csv")
    write_csv(X.universe_train(_t(spark, sf_dir)), path, sep="|")
    schema = "ID string, period string, attrition int"
    return read_csv(spark, path, schema=schema, sep="|")


def materialized_wide(spark, sf_dir) -> DataFrame:
    """The wide table written once to the shared folder and read back: later
    steps plan against a parquet scan instead of the whole star-join lineage,
    and a lost executor replays from the files, not from the raw tables."""
    t = _t(spark, sf_dir)
    inputs = [f"{t.root}/{name}.parquet" for name in ("orders", "lineitem", "events", "customer")]
    key = input_fingerprint(spark, inputs, fingerprint(WIDE_SQL))   # the SQL follows the presets
    with wide_partitions(spark, t("lineitem").count()):      # the largest input; a count of file footers
        return materialize_or_load(spark, lambda: wide_table(t), f"wide-{fingerprint(t.root)}", key)


@query("materialize_features", WIDE_SQL)
def q_materialize_features(spark, sf_dir):
    return for_check(materialized_wide(spark, sf_dir))


def _decision_from_scores(s: DataFrame) -> DataFrame:
    return s.select("ID", "period", C.two_stage_decision(C.score_to_class("bin_score"),
                                                         F.col("pred_b") % 5).alias("target"))


DECISION_SQL = ("SELECT ID, period, CAST(CASE WHEN CAST(round_even(bin_score, 0) AS INTEGER) = 0 THEN 0 "
                "ELSE pred_b % 5 + 1 END AS INTEGER) AS target FROM scored")


@query("submission", O.with_views(["scored"], DECISION_SQL))
def q_submission(spark, sf_dir):
    path = shared_path(spark, "submission_csv")
    write_csv(_decision_from_scores(X.scored(_t(spark, sf_dir))), path, sep=",")
    return read_csv(spark, path, schema="ID string, period string, target int", sep=",")


# ---------------------------------------------------------------- scalar operators

CAST_SQL = ("SELECT ID, " + O.rnd(O.to_float("age")) + " AS age, " + O.rnd(O.to_float("income"))
            + " AS income, " + O.rnd(O.to_float("payroll")) + " AS payroll, "
            + O.to_int("time_from_specialized") + " AS time_from_specialized FROM customers")


@query("cast_numeric", O.with_views(["customers"], CAST_SQL))
def q_cast_numeric(spark, sf_dir):
    c = X.customers(_t(spark, sf_dir)).select("ID", "age", "income", "payroll", "time_from_specialized")
    c = C.cast_numeric(c, FT.CUSTOMER_FLOATS)
    return for_check(C.cast_numeric(c, ["time_from_specialized"], fl=False))


@query("yes_no_binary", O.with_views(["customers"], "SELECT ID, " + ", ".join(
    f"{O.yes_no(c)} AS {c}" for c in FT.CUSTOMER_FLAGS) + " FROM customers"))
def q_yes_no_binary(spark, sf_dir):
    c = X.customers(_t(spark, sf_dir)).select("ID", *FT.CUSTOMER_FLAGS)
    return C.yes_no_binary(c, FT.CUSTOMER_FLAGS)


CODE_SQL = ("SELECT ID, period, month, " + ", ".join(f"{O.suffix(c)} AS {c}" for c in ("type", "product", "entity"))
            + ", " + ", ".join(f"{O.code_number(c)} AS {c}_number" for c in ("type", "product", "entity"))
            + " FROM balances")


@query("code_suffix", O.with_views(["balances"], CODE_SQL))
def q_code_suffix(spark, sf_dir):
    b = X.balances(_t(spark, sf_dir)).select("ID", "period", "month", "type", "product", "entity")
    nums = {f"{c}_number": C.code_number(c) for c in ("type", "product", "entity")}
    return for_check(C.split_columns(b.withColumns(nums), ["type", "product", "entity"]))


@query("period_number", O.with_views(["universe_all"], "SELECT ID, period, "
                                     + O.rnd(O.to_float(O.suffix("period"))) + " AS period2 FROM universe_all"))
def q_period_number(spark, sf_dir):
    u = X.universe_all(_t(spark, sf_dir)).select("ID", "period")
    return for_check(C.period_number(u))


def _one_hot_spec():
    return [("type", FT.BALANCE_TYPE_LEVELS, "type"), ("product", FT.BALANCE_PRODUCT_LEVELS, "product"),
            ("entity", FT.BALANCE_ENTITY_LEVELS, "entity"), ("month", FT.MONTHS, "bal_month")]


ONE_HOT_SQL = ("SELECT ID, period, " + ", ".join(
    f"(CASE WHEN {c} = {k} THEN 1 ELSE 0 END) AS {p}{k}" for c, levels, p in _one_hot_spec() for k in levels)
    + " FROM (" + O.typed_sql("balances", FT.BALANCES) + ") t")


@query("one_hot_levels", O.with_views(["balances"], ONE_HOT_SQL))
def q_one_hot_levels(spark, sf_dir):
    b = FT.typed(X.balances(_t(spark, sf_dir)), FT.BALANCES)
    cols = [x for c, levels, p in _one_hot_spec() for x in C.one_hot_columns(c, levels, p)]
    return b.select("ID", "period", *cols)


CUSTOMER_SQL = O.with_views(["customers"], O.select_rounded(
    FT.customer_columns(), set(FT.CUSTOMER_FLOATS), "(" + O.customer_features_sql() + ") c"))


@query("customer_features", CUSTOMER_SQL)
def q_customer_features(spark, sf_dir):
    return for_check(FT.customer_features(X.customers(_t(spark, sf_dir))))


@query("preview_top_n", O.with_views(["universe_all"],
                                     f"SELECT ID, period, attrition, b FROM universe_all ORDER BY ID, period "
                                     f"LIMIT {PREVIEW_ROWS}"))
def q_preview_top_n(spark, sf_dir):
    return X.universe_all(_t(spark, sf_dir)).orderBy("ID", "period").limit(PREVIEW_ROWS)


_LB_COLS = FT.output_columns(FT.LIABILITIES)
COMPOSITE_SQL = O.with_views(
    ["universe_all", "liabilities"],
    O.select_rounded(["key", "ID", "period", "attrition", *_LB_COLS], O.floating_outputs(FT.LIABILITIES),
                     "(SELECT u.ID || '_' || u.period AS key, u.ID, u.period, u.attrition, "
                     + ", ".join(f"lb.{c}" for c in _LB_COLS)
                     + " FROM universe_all u LEFT JOIN lb ON u.ID = lb.ID AND u.period = lb.period) j"),
    [("lb", O.table_features_sql("liabilities", FT.LIABILITIES))])


@query("composite_key", COMPOSITE_SQL)
def q_composite_key(spark, sf_dir):
    t = _t(spark, sf_dir)
    u = X.universe_all(t).select("ID", "period", "attrition")
    j = u.join(FT.liability_features(X.liabilities(t)), on=["ID", "period"], how="left")
    return for_check(C.composite_key(j).select("key", *j.columns))


@query("universe_union", O.with_views(["universe_train", "universe_test"], O.UNIVERSE_UNION))
def q_universe_union(spark, sf_dir):
    return universe(_t(spark, sf_dir))


@query("split_counts", O.with_views(["universe_train", "universe_test"],
                                    "SELECT partition, count(*) AS n FROM (" + O.UNIVERSE_UNION
                                    + ") u GROUP BY partition"))
def q_split_counts(spark, sf_dir):
    return universe(_t(spark, sf_dir)).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


HASH_SPLIT_SQL = ("SELECT ID, period, attrition, CASE WHEN " + O.seeded_hash(f"split{SEED}", "ID", "period")
                  + f" < {R.split_cut(0.8)} THEN 'train' ELSE 'test' END AS split FROM universe_train")


@query("hash_split", O.with_views(["universe_train"], HASH_SPLIT_SQL))
def q_hash_split(spark, sf_dir):
    return R.hash_split(X.universe_train(_t(spark, sf_dir)), ("ID", "period"), 0.8, seed=SEED)


LABEL_SQL = ("SELECT ID, period, CAST(label AS BIGINT) AS label, CASE WHEN label = 0 THEN 0 ELSE 1 END "
             "AS binary_target, CAST(label AS BIGINT) - 1 AS stage2_label FROM scored WHERE "
             "(CASE WHEN label = 0 THEN 0 ELSE 1 END) <> 0")


@query("label_transforms", O.with_views(["scored"], LABEL_SQL))
def q_label_transforms(spark, sf_dir):
    s = X.scored(_t(spark, sf_dir))
    s = s.select("ID", "period", F.col("label").cast("bigint").alias("label"),
                 C.binary_target("label").alias("binary_target"))
    return s.where(F.col("binary_target") != 0).withColumn("stage2_label", F.col("label") - 1)


ROUND_SQL = ("SELECT ID, period, raw_score, CAST(round_even(raw_score, 0) AS INTEGER) AS raw_class, "
             "CAST(round_even(bin_score, 0) AS INTEGER) AS bin_class FROM scored")


@query("round_scores", O.with_views(["scored"], ROUND_SQL))
def q_round_scores(spark, sf_dir):
    s = X.scored(_t(spark, sf_dir))
    return s.select("ID", "period", "raw_score", C.score_to_class("raw_score").alias("raw_class"),
                    C.score_to_class("bin_score").alias("bin_class"))


TWO_STAGE_SQL = ("SELECT ID, period, bp AS binary_pred, mp AS multi_pred, "
                 "CAST(CASE WHEN bp = 0 THEN 0 ELSE mp + 1 END AS INTEGER) AS target FROM "
                 "(SELECT ID, period, CAST(round_even(bin_score, 0) AS INTEGER) AS bp, pred_b % 5 AS mp "
                 "FROM scored) s")


@query("two_stage_decision", O.with_views(["scored"], TWO_STAGE_SQL))
def q_two_stage_decision(spark, sf_dir):
    s = X.scored(_t(spark, sf_dir)).select(
        "ID", "period", C.score_to_class("bin_score").alias("binary_pred"),
        (F.col("pred_b") % 5).alias("multi_pred"))
    return s.withColumn("target", C.two_stage_decision("binary_pred", "multi_pred"))


# ---------------------------------------------------------------- profiles and feature tables

def _features_sql(view: str, preset) -> str:
    cols = ["ID", "period", *FT.output_columns(preset)]
    return O.with_views([view], O.select_rounded(cols, O.floating_outputs(preset),
                                                 "(" + O.table_features_sql(view, preset) + ") f"))


@query("movement_features", _features_sql("movements", FT.MOVEMENTS))
def q_movement_features(spark, sf_dir):
    return for_check(FT.movement_features(X.movements(_t(spark, sf_dir))))


@query("liability_features", _features_sql("liabilities", FT.LIABILITIES))
def q_liability_features(spark, sf_dir):
    return for_check(FT.liability_features(X.liabilities(_t(spark, sf_dir))))


@query("balance_features", _features_sql("balances", FT.BALANCES))
def q_balance_features(spark, sf_dir):
    return for_check(FT.balance_features(X.balances(_t(spark, sf_dir))))


@query("digital_features", _features_sql("digital", FT.DIGITAL))
def q_digital_features(spark, sf_dir):
    return for_check(FT.digital_features(X.digital(_t(spark, sf_dir))))


def _profile_sql(view_sql: str, views, keys, spec, keep=None, int_cols=()) -> str:
    names = [n for n, _, _ in spec]
    if keep is not None:
        spec = [s for s in spec if s[0] in keep]
        names = [n for n in names if n in keep]

    def agg(s, c):
        e = O.stat_sql(s, c)
        return f"CAST({e} AS BIGINT)" if s == "sum" and c in int_cols else e

    aggs = ", ".join(f"{agg(s, c)} AS {n}" for n, s, c in spec)
    k = ", ".join(keys)
    inner = f"(SELECT {k}, {aggs} FROM ({view_sql}) t GROUP BY {k}) p"
    floating = {n for n, s, c in spec
                if s in ("mean", "std", "kurtosis") or (s in O.FLOATING_STATS and c not in int_cols)}
    return O.with_views(views, O.select_rounded([*keys, *names], floating, inner))


MOVEMENT_PROFILE_SPEC = P.generic_spec(FT.MOVEMENT_COLS, ["month"], "mvm")


@query("movement_profile", _profile_sql(O.typed_sql("movements", FT.MOVEMENTS), ["movements"],
                                        ["ID", "period"], MOVEMENT_PROFILE_SPEC))
def q_movement_profile(spark, sf_dir):
    m = FT.typed(X.movements(_t(spark, sf_dir)), FT.MOVEMENTS)
    return for_check(P.profile(m, ["ID", "period"], FT.MOVEMENT_COLS, ["month"], alias="mvm"))


PRESENCE_SQL = O.with_views(["balances"], "SELECT ID, period, " + ", ".join(
    f"max(CASE WHEN {c} = {k} THEN 1 ELSE 0 END) AS {p}{k}" for c, levels, p in _one_hot_spec() for k in levels)
    + " FROM (" + O.typed_sql("balances", FT.BALANCES) + ") t GROUP BY ID, period")


@query("presence_indicators", PRESENCE_SQL)
def q_presence_indicators(spark, sf_dir):
    b = FT.typed(X.balances(_t(spark, sf_dir)), FT.BALANCES)
    aggs = [a for c, levels, p in _one_hot_spec() for a in P.presence(c, levels, p)]
    return b.groupBy("ID", "period").agg(*aggs)


BALANCE_PROFILE_COLS = ("balance_amount", "days_default", "type", "product", "entity")
BALANCE_PROFILE_SPEC = P.generic_spec(BALANCE_PROFILE_COLS, ["month"], "bal")


@query("profile_generic", _profile_sql(O.typed_sql("balances", FT.BALANCES), ["balances"],
                                       ["ID", "period"], BALANCE_PROFILE_SPEC))
def q_profile_generic(spark, sf_dir):
    b = FT.typed(X.balances(_t(spark, sf_dir)), FT.BALANCES)
    return for_check(P.profile(b, ["ID", "period"], BALANCE_PROFILE_COLS, ["month"], alias="bal",
                               drop_all_null=True))


CUSTOMER_PROFILE_COLS = (*FT.CUSTOMER_FLOATS, *FT.CUSTOMER_FLAGS)
CUSTOMER_TYPED_SQL = ("SELECT ID, " + ", ".join(f"{O.to_float(c)} AS {c}" for c in FT.CUSTOMER_FLOATS) + ", "
                      + ", ".join(f"{O.yes_no(c)} AS {c}" for c in FT.CUSTOMER_FLAGS) + " FROM customers")
CUSTOMER_PROFILE_SPEC = P.generic_spec(CUSTOMER_PROFILE_COLS, None, "ctm")
# one row per customer: deviation and kurtosis are null everywhere and dropped
CUSTOMER_PROFILE_KEPT = [n for n, s, _ in CUSTOMER_PROFILE_SPEC if s not in ("std", "kurtosis")]


def _typed_customers(t: Tables) -> DataFrame:
    c = X.customers(t).select("ID", *CUSTOMER_PROFILE_COLS)
    return C.yes_no_binary(C.cast_numeric(c, FT.CUSTOMER_FLOATS), FT.CUSTOMER_FLAGS)


@query("profile_by_id", _profile_sql(CUSTOMER_TYPED_SQL, ["customers"], ["ID"], CUSTOMER_PROFILE_SPEC,
                                     keep=set(CUSTOMER_PROFILE_KEPT), int_cols=set(FT.CUSTOMER_FLAGS)))
def q_profile_by_id(spark, sf_dir):
    c = _typed_customers(_t(spark, sf_dir))
    return for_check(P.profile(c, ["ID"], CUSTOMER_PROFILE_COLS, None, alias="ctm", drop_all_null=True, few_per_key=True))


DISTINCT_COLS = ("month", "type", "product", "entity")


@query("profile_distinct", O.with_views(["balances"], "SELECT ID, period, " + ", ".join(
    f"count(DISTINCT {c}) AS count_{c}_balances" for c in DISTINCT_COLS)
    + " FROM (" + O.typed_sql("balances", FT.BALANCES) + ") t GROUP BY ID, period"))
def q_profile_distinct(spark, sf_dir):
    b = FT.typed(X.balances(_t(spark, sf_dir)), FT.BALANCES)
    return P.distinct_profile(b, ["ID", "period"], DISTINCT_COLS, "balances")


# ---------------------------------------------------------------- null handling

DIGITAL_TYPED = O.typed_sql("digital", FT.DIGITAL)
FILL_SQL = O.with_views(["digital"], "SELECT ID, period, coalesce(month, 0) AS month, " + ", ".join(
    f"{O.rnd(f'coalesce({c}, 0)')} AS {c}" for c in FT.DIGITAL_COLS) + f" FROM ({DIGITAL_TYPED}) t")


@query("fill_zero", FILL_SQL)
def q_fill_zero(spark, sf_dir):
    return for_check(N.fill_zero(FT.typed(X.digital(_t(spark, sf_dir)), FT.DIGITAL)))


LIAB_TYPED = O.typed_sql("liabilities", FT.LIABILITIES)


@query("drop_incomplete_rows", O.with_views(["liabilities"], O.select_rounded(
    ["ID", "period", "month", "product_1", "product_2"], {"product_1", "product_2"},
    f"({LIAB_TYPED}) t WHERE month IS NOT NULL AND product_1 IS NOT NULL AND product_2 IS NOT NULL")))
def q_drop_incomplete_rows(spark, sf_dir):
    return for_check(N.drop_incomplete_rows(FT.typed(X.liabilities(_t(spark, sf_dir)), FT.LIABILITIES)))


@query("drop_empty_columns", O.with_views(["universe_train", "universe_test"],
                                          "SELECT ID, period, partition FROM (" + O.UNIVERSE_UNION
                                          + ") u WHERE partition = 'test'"))
def q_drop_empty_columns(spark, sf_dir):
    test_rows = universe(_t(spark, sf_dir)).where(F.col("partition") == "test")
    return N.drop_empty_columns(test_rows)


IMPUTE_COLS = FT.output_columns(FT.LIABILITIES)
IMPUTE_SQL = O.with_views(
    ["universe_train", "universe_test", "liabilities"],
    "SELECT j.ID, j.period, j.partition, " + ", ".join(
        f"{O.rnd(f'coalesce(j.{c}, m.{c})')} AS {c}" for c in IMPUTE_COLS)
    + " FROM j JOIN m ON j.partition = m.partition",
    [("lb", O.table_features_sql("liabilities", FT.LIABILITIES)),
     ("j", "SELECT u.ID, u.period, u.partition, " + ", ".join(f"CAST(lb.{c} AS DOUBLE) AS {c}" for c in IMPUTE_COLS)
      + " FROM (" + O.UNIVERSE_UNION + ") u LEFT JOIN lb ON u.ID = lb.ID AND u.period = lb.period"),
     ("m", "SELECT partition, " + ", ".join(f"avg({c}) AS {c}" for c in IMPUTE_COLS)
      + " FROM j GROUP BY partition")])


@query("impute_mean_by_split", IMPUTE_SQL)
def q_impute_mean_by_split(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = universe(t).select("ID", "period", "partition").join(
        FT.liability_features(X.liabilities(t)), on=["ID", "period"], how="left")
    return for_check(N.impute_mean(j, IMPUTE_COLS, by="partition"))


MATRIX_DRAWS = WEIGHTED_DRAWS     # weighted draws over the minority classes of the training part
MATRIX_FEATURES = sorted(set(WIDE_COLUMNS) - {"ID", "period", "partition", "attrition"})


def _matrix_ctes() -> list[tuple[str, str]]:
    """Typed wide rows, per-split means, imputed training rows, and the two parts."""
    feats = MATRIX_FEATURES
    typed = ("SELECT ID, period, partition, attrition, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
             + " FROM wide")
    means = "SELECT partition, " + ", ".join(f"avg({c}) AS {c}" for c in feats) + " FROM wt GROUP BY partition"
    # after the fill a feature is null only where its split has no value at
    # all; such columns are not model inputs and do not drop rows
    imp = ("SELECT wt.ID, wt.period, CAST(wt.attrition AS BIGINT) AS attrition, "
           "CASE WHEN wt.attrition = 0 THEN 0 ELSE 1 END AS binary_target, "
           + ", ".join(f"coalesce(wt.{c}, m.{c}) AS {c}" for c in feats)
           + " FROM wt JOIN m ON wt.partition = m.partition WHERE wt.partition = 'train' AND attrition IS NOT NULL")
    cut = f"{O.seeded_hash(f'split{SEED}', 'ID', 'period')} < {R.split_cut(0.8)}"
    return [*O.wide_ctes(), ("wt", typed), ("m", means), ("imp", imp),
            ("fit_part", f"SELECT * FROM imp WHERE {cut}"), ("eval_part", f"SELECT * FROM imp WHERE NOT {cut}")]


_MATRIX_SELECT = ", ".join(f"{O.rnd(f'r.{c}')} AS {c}" for c in MATRIX_FEATURES)


def _matrix_sql() -> str:
    weights = ", ".join(f"({i}, {w!r})" for i, w in enumerate(WEIGHTS, start=1))
    draw = O.md5_int(f"'draw{SEED}:' || CAST(quota.attrition AS VARCHAR) || ':' || CAST(g.i AS VARCHAR)")
    ctes = [*_matrix_ctes(),
            ("rk", "SELECT attrition, n, row_number() OVER (ORDER BY n DESC, attrition) - 1 AS freq_rank "
                   "FROM (SELECT attrition, count(*) AS n FROM fit_part GROUP BY attrition)"),
            ("quota", f"SELECT rk.attrition, rk.n, CAST(round_even({MATRIX_DRAWS} * CAST(w.wt AS DOUBLE), 0) AS BIGINT) "
                      f"AS q FROM rk JOIN (VALUES {weights}) w(freq_rank, wt) ON rk.freq_rank = w.freq_rank"),
            ("draws", f"SELECT quota.attrition, g.i AS draw, {draw} % quota.n AS rnk FROM quota, "
                      f"range(0, {MATRIX_DRAWS}) g(i) WHERE g.i < quota.q"),
            ("ranked", "SELECT *, row_number() OVER (PARTITION BY attrition ORDER BY "
                       + O.seeded_hash(f"row{SEED}", "ID", "period") + ", ID, period) - 1 AS rnk FROM fit_part")]
    cols = f"r.ID, r.period, {_MATRIX_SELECT}, r.attrition, r.binary_target"
    body = (f"SELECT {cols}, CAST(NULL AS BIGINT) AS draw FROM ranked r "
            "WHERE r.attrition = (SELECT attrition FROM rk WHERE freq_rank = 0) UNION ALL "
            f"SELECT {cols}, d.draw FROM draws d JOIN ranked r ON r.attrition = d.attrition AND r.rnk = d.rnk")
    return O.with_views(O.WIDE_VIEWS, body, ctes)


def model_rows(spark, sf_dir) -> tuple[FT.ModelMatrix, DataFrame, DataFrame]:
    """The model matrix, its rebalanced training part and its held-out part."""
    mm = FT.feature_matrix(materialized_wide(spark, sf_dir), seed=SEED)
    return mm, *FT.training_rows(mm, MATRIX_DRAWS, WEIGHTS, seed=SEED)


@query("feature_matrix", _matrix_sql())
def q_feature_matrix(spark, sf_dir):
    return for_check(model_rows(spark, sf_dir)[1])


@query("feature_matrix_held_out", O.with_views(
    O.WIDE_VIEWS, f"SELECT r.ID, r.period, {_MATRIX_SELECT}, r.attrition, r.binary_target FROM eval_part r", _matrix_ctes()))
def q_feature_matrix_held_out(spark, sf_dir):
    return for_check(model_rows(spark, sf_dir)[2])


# ---------------------------------------------------------------- joins

@query("feature_star_join", WIDE_SQL)
def q_feature_star_join(spark, sf_dir):
    return for_check(wide_table(_t(spark, sf_dir)))


_CU_COLS = FT.customer_columns()
INNER_SQL = O.with_views(
    ["universe_train", "universe_test", "customers"],
    O.select_rounded(["ID", "period", "attrition", "partition", *_CU_COLS[1:]], set(FT.CUSTOMER_FLOATS),
                     "(SELECT u.*, " + ", ".join(f"cu.{c}" for c in _CU_COLS[1:])
                     + f" FROM ({O.UNIVERSE_UNION}) u JOIN cu ON u.ID = cu.ID) j"),
    [("cu", O.customer_features_sql())])


@query("customer_inner_join", INNER_SQL)
def q_customer_inner_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = FT.feature_star_join(universe(t), [], FT.customer_features(X.customers(t)), how_customers="inner")
    return for_check(j)


# ---------------------------------------------------------------- histogram, draws, rebalancing

HIST_CTES = [("hist", "SELECT attrition, count(*) AS n FROM universe_train GROUP BY attrition"),
             ("rk", "SELECT attrition, n, CAST(row_number() OVER (ORDER BY n DESC, attrition) - 1 AS INTEGER) "
                    "AS freq_rank FROM hist")]


@query("class_histogram", O.with_views(["universe_train"], "SELECT attrition, n, freq_rank FROM rk", HIST_CTES))
def q_class_histogram(spark, sf_dir):
    return R.class_histogram(X.universe_train(_t(spark, sf_dir)), "attrition")


RANKED_CTE = ("ranked", "SELECT ID, period, attrition, row_number() OVER (PARTITION BY attrition ORDER BY h, ID, period)"
                        " - 1 AS rnk FROM (SELECT *, " + O.seeded_hash(f"row{SEED}", "ID", "period")
              + " AS h FROM universe_train) x")


def _draws_sql(quota_sql: str, max_draws: int, keep_majority: bool) -> str:
    draw_hash = O.md5_int(f"'draw{SEED}:' || CAST(quota.attrition AS VARCHAR) || ':' || CAST(g.i AS VARCHAR)")
    ctes = [*HIST_CTES, ("quota", quota_sql),
            ("draws", f"SELECT quota.attrition, g.i AS draw, {draw_hash} % quota.n AS rnk FROM quota, "
                      f"range(0, {max_draws}) g(i) WHERE g.i < quota.q"),
            RANKED_CTE]
    body = ("SELECT r.ID, r.period, r.attrition, d.draw FROM draws d JOIN ranked r "
            "ON r.attrition = d.attrition AND r.rnk = d.rnk")
    if keep_majority:
        body = ("SELECT ID, period, attrition, CAST(NULL AS BIGINT) AS draw FROM universe_train "
                "WHERE attrition = (SELECT attrition FROM rk WHERE freq_rank = 0) UNION ALL " + body)
    return O.with_views(["universe_train"], body, ctes)


@query("sample_with_replacement", _draws_sql(
    f"SELECT attrition, n, {DRAWS_PER_CLASS} AS q FROM rk", DRAWS_PER_CLASS, keep_majority=False))
def q_sample_with_replacement(spark, sf_dir):
    u = X.universe_train(_t(spark, sf_dir))
    return R.sample_with_replacement(u, "attrition", ("ID", "period"), DRAWS_PER_CLASS, seed=SEED)


@query("resample_uniform", _draws_sql(
    f"SELECT attrition, n, {UNIFORM_DRAWS} AS q FROM rk WHERE freq_rank > 0", UNIFORM_DRAWS, keep_majority=True))
def q_resample_uniform(spark, sf_dir):
    u = X.universe_train(_t(spark, sf_dir))
    return R.rebalance(u, "attrition", ("ID", "period"), UNIFORM_DRAWS, seed=SEED)


_W_VALUES = ", ".join(f"({i}, {w!r})" for i, w in enumerate(WEIGHTS, start=1))


@query("resample_weighted", _draws_sql(
    f"SELECT rk.attrition, rk.n, CAST(round_even({WEIGHTED_DRAWS} * CAST(w.wt AS DOUBLE), 0) AS BIGINT) AS q "
    f"FROM rk JOIN (VALUES {_W_VALUES}) w(freq_rank, wt) ON rk.freq_rank = w.freq_rank",
    WEIGHTED_DRAWS, keep_majority=True))
def q_resample_weighted(spark, sf_dir):
    u = X.universe_train(_t(spark, sf_dir))
    return R.rebalance(u, "attrition", ("ID", "period"), WEIGHTED_DRAWS, weights=WEIGHTS, seed=SEED)


# ---------------------------------------------------------------- metrics and stacking

CONF_CTES = [
    ("conf", "SELECT label, pred_a AS prediction, count(*) AS n FROM scored GROUP BY label, pred_a"),
    ("pc", "SELECT label AS cls, n AS actual, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp "
           "FROM conf UNION ALL SELECT prediction AS cls, 0 AS actual, n AS predicted, 0 AS tp FROM conf"),
    ("pm", "SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(actual) AS DOUBLE) AS support, "
           "CAST(sum(predicted) AS DOUBLE) AS predicted FROM pc GROUP BY cls"),
]


@query("macro_f1", O.with_views(["scored"], "SELECT " + O.rnd(
    "avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END)")
    + " AS macro_f1, count(*) AS n_labels FROM pm", CONF_CTES))
def q_macro_f1(spark, sf_dir):
    return for_check(M.macro_f1(X.scored(_t(spark, sf_dir)), "label", "pred_a"))


@query("precision_by_label", O.with_views(["scored"], "SELECT cls AS label, " + O.rnd(
    "CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END") + " AS precision FROM pm", CONF_CTES))
def q_precision_by_label(spark, sf_dir):
    return for_check(M.precision_by_label(X.scored(_t(spark, sf_dir)), "label", "pred_a"))


def stacked(t: Tables) -> DataFrame:
    """Two model families' hierarchical predictions beside the truth, joined
    on (ID, period)."""
    s = X.scored(t)
    fam_a = s.select("ID", "period", C.two_stage_decision(C.score_to_class("bin_score"),
                                                          F.col("pred_a") % 5).alias("pred_a"))
    fam_b = s.select("ID", "period", "label", C.two_stage_decision(
        F.when(F.col("pred_b") == 0, 0).otherwise(1), F.col("pred_b") % 5).alias("pred_b"))
    return fam_a.join(fam_b, on=["ID", "period"]).select("ID", "period", "pred_a", "pred_b",
                                                         F.col("label").alias("real"))


STACK_SQL = ("SELECT a.ID, a.period, a.pred_a, b.pred_b, b.label AS real FROM "
             "(SELECT ID, period, CAST(CASE WHEN CAST(round_even(bin_score, 0) AS INTEGER) = 0 THEN 0 "
             "ELSE pred_a % 5 + 1 END AS INTEGER) AS pred_a FROM scored) a JOIN "
             "(SELECT ID, period, label, CAST(CASE WHEN (CASE WHEN pred_b = 0 THEN 0 ELSE 1 END) = 0 THEN 0 "
             "ELSE pred_b % 5 + 1 END AS INTEGER) AS pred_b FROM scored) b ON a.ID = b.ID AND a.period = b.period")


@query("stack_inputs", O.with_views(["scored"], STACK_SQL))
def q_stack_inputs(spark, sf_dir):
    return stacked(_t(spark, sf_dir))


STACK_INPUTS = ("pred_a", "pred_b")
IS_HELD_OUT = f"{O.seeded_hash(f'split{SEED}', 'ID', 'period')} >= {R.split_cut(0.8)}"


def stack_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The stacked predictions of the held-out training rows, on which the
    stacker is fitted, and of the scoring rows."""
    rows = stacked(t).join(X.universe_all(t).select("ID", "period", "b"), ["ID", "period"])
    tagged = R.hash_split(rows, ("ID", "period"), 0.8, seed=SEED)
    return tagged.where("b < 80 and split = 'test'"), tagged.where("b >= 80")


OLS_CTES = [
    ("st", STACK_SQL),
    ("s", f"SELECT st.ID, st.period, u.b AS bucket, CAST(real AS DOUBLE) AS y, CAST(pred_a AS DOUBLE) AS a, "
          "CAST(pred_b AS DOUBLE) AS b FROM st JOIN universe_all u ON st.ID = u.ID AND st.period = u.period"),
    ("mo", "SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, "
           "covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM s "
           f"WHERE bucket < 80 AND {IS_HELD_OUT}"),
    ("co", "SELECT my, ma, mb, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ca, "
           "(saa * sby - sab * say) / (saa * sbb - sab * sab) AS cb FROM mo"),
]


@query("linear_stack_fit", O.with_views(["scored"], "SELECT " + O.rnd("my - ca * ma - cb * mb")
                                        + " AS intercept, " + O.rnd("ca") + " AS coef_pred_a, " + O.rnd("cb")
                                        + " AS coef_pred_b FROM co", OLS_CTES))
def q_linear_stack_fit(spark, sf_dir):
    held_out, _ = stack_parts(_t(spark, sf_dir))
    model = ML.fit_linear_stack(held_out.select("real", *STACK_INPUTS), STACK_INPUTS, "real")
    return for_check(ML.linear_stack_coefficients(model, STACK_INPUTS, spark))


@query("linear_stack_score", O.with_views(
    ["scored"], "SELECT s.ID, s.period, CAST(round_even(co.my - co.ca * co.ma - co.cb * co.mb + co.ca * s.a "
                "+ co.cb * s.b, 0) AS INTEGER) AS target FROM s, co WHERE s.bucket >= 80", OLS_CTES))
def q_linear_stack_score(spark, sf_dir):
    """Fitted on held-out rows, scored on the scoring rows, written and read back."""
    held_out, scoring = stack_parts(_t(spark, sf_dir))
    model = ML.fit_linear_stack(held_out.select("real", *STACK_INPUTS), STACK_INPUTS, "real")
    path = shared_path(spark, "stack_submission_csv")
    ML.submit(ML.linear_stack_score(model, scoring, STACK_INPUTS), path)
    return read_csv(spark, path, schema="ID string, period string, target int")


DEPENDENT_CTES = [*OLS_CTES[:2], (
    "m1", "SELECT avg(y) AS my, avg(a) AS ma, covar_pop(a, y) / (2 * var_pop(a)) AS c FROM s "
          f"WHERE bucket < 80 AND {IS_HELD_OUT}")]


@query("linear_stack_dependent", O.with_views(["scored"], "SELECT " + O.rnd("my - 2 * c * ma") + " AS intercept, "
                                              + O.rnd("c") + " AS coef_pred_a, " + O.rnd("c")
                                              + " AS coef_pred_b FROM m1", DEPENDENT_CTES))
def q_linear_stack_dependent(spark, sf_dir):
    """Two families that agree everywhere: of all best fits the one with the smallest coefficients."""
    held_out, _ = stack_parts(_t(spark, sf_dir))
    same = held_out.select("real", "pred_a", F.col("pred_a").alias("pred_b"))
    return for_check(ML.linear_stack_coefficients(ML.fit_linear_stack(same, STACK_INPUTS, "real"), STACK_INPUTS, spark))


@query("stack_sink", O.with_views(["scored"], f"SELECT pred_a, pred_b, real FROM ({STACK_SQL}) x WHERE {IS_HELD_OUT}"))
def q_stack_sink(spark, sf_dir):
    """The labelled-prediction file of the held-out rows, written and read back."""
    rows = R.hash_split(stacked(_t(spark, sf_dir)), ("ID", "period"), 0.8, seed=SEED).where("split = 'test'")
    path = shared_path(spark, "stacked_csv")
    write_csv(rows.select("pred_a", "pred_b", "real"), path, sep=",")
    return read_csv(spark, path, schema="pred_a int, pred_b int, real int")


_TEXT_SELECT = ("SELECT doc_id, text, '  ' || text || ' ' AS padded, '\"' || source || '\"|,' || chr(10) AS quoted, "
                "CASE WHEN lang = 'en' THEN '' ELSE lang END AS emptied, nullif(lang, 'en') AS missing FROM documents")


@query("csv_text_roundtrip", _TEXT_SELECT)
def q_csv_text_roundtrip(spark, sf_dir):
    """Texts with line ends, quotes, separators, padding, empty ones and nulls,
    written as delimited text and read back."""
    rows = spark.sql(_TEXT_SELECT.replace("FROM documents", "FROM {docs}"), docs=_t(spark, sf_dir)("documents"))
    path = shared_path(spark, "texts_csv")
    write_csv(rows, path, sep="|")
    return read_csv(spark, path, schema=rows.schema, sep="|")


@query("text_star_join", WIDE_SQL)
def q_text_star_join(spark, sf_dir):
    """The star join from staged text: the five tables are written as
    packed ``|``-separated files and read back by column name."""
    t = _t(spark, sf_dir)
    largest = t("lineitem").count()

    def through_text(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, f"{name}_csv")
        with wide_partitions(spark, largest):
            write_csv(df.select(*sorted(df.columns)), path, sep="|", compression="gzip")
        return read_csv(spark, path, schema=df.schema, sep="|").select(*df.columns)

    feats = [through_text(f, n) for n, f in (
        ("movements", FT.movement_features(X.movements(t))), ("liabilities", FT.liability_features(X.liabilities(t))),
        ("balances", FT.balance_features(X.balances(t))), ("digital", FT.digital_features(X.digital(t))))]
    cust = through_text(FT.customer_features(X.customers(t)), "customers")
    return for_check(FT.feature_star_join(universe(t), feats, cust))


# ---------------------------------------------------------------- models (value checks)

@query("random_split", O.with_views(["universe_train"],
                                    "SELECT count(*) AS n, count(*) AS n_keys, true AS share_ok FROM universe_train"))
def q_random_split(spark, sf_dir):
    """Every row lands on exactly one side, and the sides have their shares
    (within five standard deviations)."""
    u = X.universe_train(_t(spark, sf_dir))
    train, test = R.random_split(u, (0.8, 0.2), seed=SEED)
    both = train.withColumn("side", F.lit(1)).unionByName(test.withColumn("side", F.lit(0)))
    n, share = F.count(F.lit(1)), F.avg("side")
    return both.agg(n.alias("n"), F.count_distinct("ID", "period").alias("n_keys"),
                    (F.abs(share - 0.8) <= 5 * F.sqrt(F.lit(0.16) / n)).alias("share_ok"))


#: A row drawn many times enters the forest as so many weighted copies, so that its bootstrap thins them.
FOREST_COPIES = 16


def counted_rows(spark, sf_dir) -> tuple[FT.ModelMatrix, DataFrame, DataFrame, DataFrame]:
    """Model matrix, its training rows with the number of their draws, its held-out
    rows and its scoring rows, each written once for all fits."""
    mm, train, held_out, scoring = _counted(spark, sf_dir)
    with plain_constraints(spark):
        return mm, stage(train, "model-rows"), stage(held_out, "held-out-rows"), stage(scoring, "scoring-rows")


def _counted(spark, sf_dir) -> tuple[FT.ModelMatrix, DataFrame, DataFrame, DataFrame]:
    with plain_constraints(spark):
        mm = FT.feature_matrix(materialized_wide(spark, sf_dir), seed=SEED, staged=False)
        train, held_out = FT.counted_training_rows(mm, MATRIX_DRAWS, WEIGHTS, seed=SEED)
        return mm, train, held_out, mm.validation.fillna(0.0, mm.features)


def forest_rows(spark, sf_dir) -> tuple[FT.ModelMatrix, DataFrame, DataFrame, DataFrame]:
    """As ``counted_rows`` for a forest, which reads its training rows several times, the scoring rows
    once and the held-out rows never: training rows are assembled once and written as one vector
    column, the others are left as they are."""
    mm, train, held_out, scoring = _counted(spark, sf_dir)
    with plain_constraints(spark):
        train = stage(ML.assemble(train, mm.features).select("ID", "period", "attrition", "times", "features"), "forest-rows")
    return mm, train, held_out, scoring


def boosting_rows(spark, sf_dir) -> tuple[FT.ModelMatrix, DataFrame, DataFrame, DataFrame]:
    """As ``counted_rows`` for boostings, which read their training rows for the thresholds and once to bin them, the
    held-out rows once, and of the scoring rows the columns that trees split by: only the training rows are written."""
    mm, train, held_out, scoring = _counted(spark, sf_dir)
    with plain_constraints(spark):
        return mm, stage(train, "model-rows"), held_out, scoring


#: Macro F1 that a model must reach on the scoring rows. The label follows from a
#: feature, so a sound pipeline comes close to 1.
F1_BAR = {"rf": 0.9, "deep": 0.9, "light": 0.9, "column_subsampled": 0.9, "stack": 0.9}


def _submitted(spark, sf_dir, name: str, path: str) -> DataFrame:
    """Read a submission back and compare it with the withheld labels."""
    back = read_csv(spark, path, schema="ID string, period string, target int")
    truth = X.universe_all(_t(spark, sf_dir)).where("b >= 80").select("ID", "period", "attrition")
    joined = truth.join(back, ["ID", "period"], "left")
    f1 = M.macro_f1(joined, "attrition", "target").first()["macro_f1"]   # one number
    return joined.agg(F.lit(name).alias("model"), F.count("target").alias("n"), F.lit(f1 >= F1_BAR[name]).alias("good"))


def _submissions(spark, sf_dir, scored: Callable[[tuple], dict[str, DataFrame]], *names: str,
                 rows: Callable = counted_rows) -> DataFrame:
    """Submit what ``scored`` (a function of what ``rows`` gives) gives for each model, and judge
    the files. The matrices and whatever the fits staged are deleted once the files are written."""
    paths = {name: shared_path(spark, f"{name}_csv") for name in names}
    with staging_area(spark):
        for name, out in scored(rows(spark, sf_dir)).items():
            with plain_constraints(spark):
                ML.submit(out, paths[name])
    judged = [_submitted(spark, sf_dir, name, path) for name, path in paths.items()]
    out = judged[0]
    for other in judged[1:]:
        out = out.unionByName(other)
    return out


def _model_sql(*names: str) -> str:
    return O.with_views(["universe_test"], " UNION ALL ".join(
        f"SELECT '{n}' AS model, count(*) AS n, true AS good FROM universe_test" for n in names))


@query("rf_predict", _model_sql("rf"))
def q_rf_predict(spark, sf_dir):
    def scored(rows):
        mm, train, _, scoring = rows
        copies = F.least(F.col("times"), F.lit(FOREST_COPIES))
        train = train.withColumn("weight", F.col("times") / copies).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        model, feats = ML.fit_random_forest(train, mm.features, "attrition", seed=SEED, numTrees=50, maxDepth=10,
                                            featureSubsetStrategy="onethird", weightCol="weight")
        return {"rf": ML.predict_random_forest(model, feats, scoring)}

    return _submissions(spark, sf_dir, scored, "rf", rows=forest_rows)


def _two_stage(spark, sf_dir, **presets) -> DataFrame:
    def scored(rows):
        mm, train, held_out, scoring = rows
        with plain_constraints(spark):      # the held-out rows are projections
            models = ML.fit_presets(train, held_out, mm.features, presets, times="times")
        return {name: model.transform(scoring) for name, model in models.items()}

    return _submissions(spark, sf_dir, scored, *presets, rows=boosting_rows)


@query("two_stage_predict", _model_sql("deep"))
def q_two_stage_predict(spark, sf_dir):
    return _two_stage(spark, sf_dir, deep=ML.DEEP)


@query("two_stage_presets", _model_sql("light", "column_subsampled"))
def q_two_stage_presets(spark, sf_dir):
    return _two_stage(spark, sf_dir, light=ML.LIGHT, column_subsampled=ML.COLUMN_SUBSAMPLED)


STACK_FAMILIES = {"deep": ML.DEEP, "column_subsampled": ML.COLUMN_SUBSAMPLED}


@query("fitted_stack", _model_sql("stack"))
def q_fitted_stack(spark, sf_dir):
    """Least squares over two fitted families: their held-out predictions go through
    the labelled-prediction file, the stacked scores through the submission."""
    def scored(rows):
        mm, train, held_out, scoring = rows
        _, known, asked = ML.stack_families(train, held_out, scoring, mm.features, STACK_FAMILIES, times="times", seed=SEED)
        inputs = [f"pred_{name}" for name in STACK_FAMILIES]
        path = shared_path(spark, "stack_families_csv")
        write_csv(known.select(*inputs, "real"), path, sep=",")
        back = read_csv(spark, path, schema=", ".join(f"{c} int" for c in (*inputs, "real")))
        model = ML.fit_linear_stack(back, inputs, "real")
        return {"stack": ML.linear_stack_score(model, asked, inputs)}

    return _submissions(spark, sf_dir, scored, "stack")
