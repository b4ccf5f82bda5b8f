"""Classification metrics from one confusion aggregation.

``groupBy(label, prediction).count()`` is the only pass over the scored
rows (partial aggregation, tiny output: classes²). Everything after it
runs on that small table, still as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts of (label, prediction); rows without a label are left out, a row
    without a prediction is a miss of its label."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_label_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision, recall, F1 and support for every class seen as a label or a
    prediction; a zero denominator gives 0 (as scikit-learn reports)."""
    conf = confusion(df, label, pred)
    types = dict(df.dtypes)
    if types[label] != types[pred]:  # e.g. integer labels against model predictions
        conf = conf.select(F.col("label").cast("double").alias("label"),
                           F.col("prediction").cast("double").alias("prediction"), "n")
    per_class = conf.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"),
                     F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("actual"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )).alias("s")).select("s.*").where("cls is not null")
    m = per_class.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"),
                                     F.sum("predicted").alias("predicted"))
    tp, sup, prd = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    return m.select(
        F.col("cls").alias("label"),
        F.when(prd > 0, tp / prd).otherwise(0.0).alias("precision"),
        F.when(sup > 0, tp / sup).otherwise(0.0).alias("recall"),
        F.when(sup + prd > 0, 2 * tp / (sup + prd)).otherwise(0.0).alias("f1"),
        sup.alias("support"),
    )


def macro_f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Unweighted mean of per-class F1 (Spark's evaluator ``f1`` is
    support-weighted, so it is not used)."""
    return per_label_metrics(df, label, pred).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def precision_by_label(df: DataFrame, label: str, pred: str, metric_label=None) -> DataFrame:
    """Precision of each class, or of ``metric_label`` only."""
    m = per_label_metrics(df, label, pred).select("label", "precision")
    return m if metric_label is None else m.where(F.col("label") == F.lit(metric_label))
