"""Stand-in input tables built from the driver's TPC-H-style parquet.

The pipeline consumes customer tables (balances, customers, liabilities,
movements, digital, the labelled universe). The test data ships other
tables, so each input is derived from them with plain DataFrame
expressions; the same definitions exist as SQL text in
``plans/oracle.py`` for the DuckDB check. Each builder reads only the
columns it needs; filters reach the parquet scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import percent_bucket
from .tables import Tables


def _s(c: Column) -> Column:
    return c.cast("string")


def base_orders(t: Tables) -> DataFrame:
    o = t("orders")
    return o.select(
        _s(F.col("o_custkey")).alias("ID"),
        F.concat(F.lit("period_"), _s(F.year("o_orderdate") - 1994)).alias("period"),
        F.month("o_orderdate").cast("int").alias("month"),
        "o_orderkey", "o_totalprice", "o_orderstatus",
    )


def universe_all(t: Tables) -> DataFrame:
    """One row per (ID, period) with a six-class label and a 0..99 bucket."""
    g = base_orders(t).groupBy("ID", "period").agg(
        F.least(F.count(F.lit(1)) - 1, F.lit(5)).cast("int").alias("attrition"))
    return g.withColumn("b", percent_bucket("ID", "period"))


def universe_train(t: Tables) -> DataFrame:
    return universe_all(t).where(F.col("b") < 80).select("ID", "period", "attrition")


def universe_test(t: Tables) -> DataFrame:
    return universe_all(t).where(F.col("b") >= 80).select("ID", "period")


def liabilities(t: Tables) -> DataFrame:
    return base_orders(t).select(
        "ID", "period", "month", F.col("o_totalprice").alias("product_1"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.1).alias("product_2"))


def _order_lines(t: Tables) -> DataFrame:
    li = t("lineitem")
    return base_orders(t).join(li, F.col("l_orderkey") == F.col("o_orderkey"))


def movements(t: Tables) -> DataFrame:
    return _order_lines(t).select(
        "ID", "period", "month", F.col("l_quantity").alias("type_1"),
        F.col("l_extendedprice").alias("type_2"), F.col("l_discount").alias("type_3"),
        F.col("l_tax").alias("type_4"))


def balances(t: Tables) -> DataFrame:
    partkey = F.col("l_partkey")
    return _order_lines(t).select(
        "ID", "period", "month",
        F.concat(F.lit("type_"), _s(F.col("l_linenumber"))).alias("type"),
        F.when(partkey % 50 == 0, F.lit("unknown"))
         .otherwise(F.concat(F.lit("product_"), _s(partkey % 7 + 1))).alias("product"),
        F.concat(F.lit("entity_"), _s(F.col("l_suppkey") % 5 + 1)).alias("entity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("balance_amount"),
        F.when(F.col("l_returnflag") == "R", partkey % 120).otherwise(0).cast("int").alias("days_default"),
    )


def digital(t: Tables) -> DataFrame:
    e = t("events")
    event_id, value, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    cols = [
        _s(F.col("user_id")).alias("ID"),
        F.concat(F.lit("period_"), _s(F.dayofmonth("ts") % 7 + 1)).alias("period"),
        (event_id % 12 + 1).cast("int").alias("month"),
        F.when(event_id % 2 == 0, F.lit(None)).otherwise(value).cast("double").alias("dig_1"),
        (value * 2).alias("dig_2"),
    ]
    for i, name in enumerate(["purchase", "click", "view", "signup", "error"], start=3):
        cols.append(F.when(kind == name, value).alias(f"dig_{i}"))
    cols += [
        (event_id % 10).cast("double").alias("dig_8"),
        (event_id % 3).cast("double").alias("dig_9"),
        F.lit(1).cast("double").alias("dig_10"),
        (value - 100).alias("dig_11"),
    ]
    return e.select(*cols)


def customers(t: Tables) -> DataFrame:
    c = t("customer")
    k = F.col("c_custkey")

    def yes_if(mod, other="No"):
        return F.when(k % mod == 0, F.lit("Yes")).otherwise(F.lit(other))

    return c.select(
        _s(k).alias("ID"),
        F.when(k % 11 == 0, F.lit("none"))
         .otherwise(F.concat(F.lit("type_job_"), _s(F.col("c_nationkey") % 7 + 1))).alias("type_job"),
        F.concat(F.lit("risk_"), _s(k % 9 + 1)).alias("bureau_risk"),
        yes_if(2).alias("product_1"),
        F.when(k % 3 == 0, F.lit("yes")).otherwise(F.lit("Yes")).alias("product_2"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit("Yes")).cast("string").alias("product_3"),
        yes_if(5).alias("product_4"),
        yes_if(6).alias("ofert_1"),
        yes_if(7).alias("ofert_2"),
        yes_if(8).alias("ofert_3"),
        _s(18 + k % 60).alias("age"),
        F.col("c_acctbal").alias("income"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("c_acctbal") * 0.1).cast("double").alias("payroll"),
        F.when(k % 13 == 0, F.lit(""))
         .otherwise(F.concat(_s(k % 6), F.lit(".0"))).alias("time_from_specialized"),
    )


def scored(t: Tables) -> DataFrame:
    """Fixed prediction columns for metric and decision operators."""
    u = universe_all(t)
    b, a = F.col("b"), F.col("attrition")
    return u.select(
        "ID", "period", a.alias("label"), "b",
        (b % 8).cast("double") * 0.5,
        b.cast("double") / 100,
        F.when(b % 10 < 7, a).otherwise((a + 1) % 6).cast("int"),
        F.when(b % 7 < 5, a).otherwise((a + 2) % 6).cast("int"),
    ).toDF("ID", "period", "label", "b", "raw_score", "bin_score", "pred_a", "pred_b")


VIEWS = {
    "base_orders": base_orders,
    "universe_all": universe_all,
    "universe_train": universe_train,
    "universe_test": universe_test,
    "liabilities": liabilities,
    "movements": movements,
    "balances": balances,
    "digital": digital,
    "customers": customers,
    "scored": scored,
}
