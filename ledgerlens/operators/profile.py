"""Grouped profiles: many statistics of many columns in ONE aggregation.

Every statistic used here (avg, stddev_samp, min, max, population kurtosis,
sum, count, max of an indicator) is algebraic: Spark runs a partial
``HashAggregate`` before the shuffle and a final one after it, so a key
that owns a third of all rows still sends one partial row per map task, not
its raw rows. Distinct counts of codes are bit maps in one long."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ROWS_PER_TASK, wide_partitions
from ..sources.materialize import stage
from .nulls import drop_empty_columns

# statistic name -> Spark SQL aggregate, for expression strings
STAT_SQL = {
    "mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "max": "max({})",
    "kurtosis": "kurtosis({})", "sum": "sum({})", "count": "count({})",
}


def _literal(level) -> str:
    """SQL text of a level: numbers as they are, text quoted."""
    if isinstance(level, str):
        return "'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(level)


def presence(c: str, levels: Sequence, prefix: str) -> list[Column]:
    """``prefix{k}`` = 1 if any row of the group has ``c == k`` else 0.
    The indicator is built inside the aggregate, so no one-hot columns are
    materialised before the shuffle. All indicators of a column read one
    aggregate, a bit map in one long, so a partial row holds one number for them."""
    if 0 < len(levels) <= BITMAP_LEVELS and len(set(levels)) == len(levels):
        bits = " ".join(f"WHEN `{c}` = {_literal(k)} THEN {1 << i}L" for i, k in enumerate(levels))
        seen = f"bit_or(CASE {bits} ELSE 0L END)"
        return [F.expr(f"CAST(shiftright({seen}, {i}) & 1L AS INT) AS `{prefix}{k}`") for i, k in enumerate(levels)]
    return [F.expr(f"max(CASE WHEN `{c}` = {_literal(k)} THEN 1 ELSE 0 END) AS `{prefix}{k}`") for k in levels]


def spec_columns(spec: Iterable[tuple[str, str, str]]) -> list[Column]:
    """``spec`` rows are (output name, statistic, input column). Built as SQL
    expression strings: one JVM call per aggregate instead of one per node,
    which matters for tables with close to a hundred statistics."""
    return [F.expr(f"{STAT_SQL[s].format(f'`{c}`')} AS `{name}`") for name, s, c in spec]


def aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*columns)


# Statistic suffixes and their order in the list-driven profile.
GENERIC_STATS = ("mean", "stv", "min", "max", "kurtosis", "sum")
_GENERIC_TO_STAT = {"mean": "mean", "stv": "std", "min": "min", "max": "max",
                    "kurtosis": "kurtosis", "sum": "sum"}


def generic_spec(value_cols: Sequence[str], count_cols: Sequence[str] | None, alias: str,
                 stats: Sequence[str] = GENERIC_STATS) -> list[tuple[str, str, str]]:
    """Names ``{alias}_{col}_{stat}`` for each value column, then
    ``{alias}_{col}_count`` for each count column."""
    spec = [(f"{alias}_{c}_{s}", _GENERIC_TO_STAT[s], c) for c in value_cols for s in stats]
    spec += [(f"{alias}_{c}_count", "count", c) for c in (count_cols or [])]
    return spec


def profile(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
            count_cols: Sequence[str] | None = None, alias: str = "p",
            stats: Sequence[str] = GENERIC_STATS, drop_all_null: bool = False, few_per_key: bool = False) -> DataFrame:
    """List-driven profile: one ``groupBy(keys).agg`` for every statistic of
    every column; the group keys are kept. With ``drop_all_null`` the output
    columns that are null on every row are removed: the profile is first
    written to the shared folder (it is much smaller than its input), so the
    non-null count and the result read it instead of aggregating twice.

    A task's table of groups is ten times as wide as the rows behind it. With
    ``few_per_key`` (about a row a group, so that partial aggregation saves
    nothing) the rows are first dealt out, ``ROWS_PER_TASK`` to a task, by all their columns;
    a table in one large row group would otherwise be one task's groups."""
    rows = df.count() if few_per_key else 0
    if rows > ROWS_PER_TASK:
        df = df.repartition(-(-rows // ROWS_PER_TASK), *df.columns)
    out = aggregate(df, keys, spec_columns(generic_spec(value_cols, count_cols, alias, stats)))
    if not drop_all_null:
        return out
    with wide_partitions(df.sparkSession, rows):
        staged = stage(out, "profile")
    return drop_empty_columns(staged, keep=keys)


#: Values of a column that fit the bit map of one long.
BITMAP_LEVELS = 63


def _as_text(df: DataFrame, c: str) -> Column:
    """Text that is equal where values are; both zeros of a float are one value."""
    zero = F.col(c) + F.lit(0.0) if df.schema[c].dataType.typeName() in ("float", "double") else F.col(c)
    return zero.cast("string")


def code_levels(df: DataFrame, cols: Sequence[str], most: int = BITMAP_LEVELS) -> dict[str, list]:
    """The distinct non-null values, in order, of each column that has at most ``most``; a
    column with more is left out. One pass; at most ``most`` + 1 values a column reach the driver."""
    if not cols:
        return {}
    each = [F.struct(F.lit(c).alias("col"), _as_text(df, c).alias("value")) for c in cols]
    found = df.select(F.inline(F.array(*each)))
    place = F.row_number().over(Window.partitionBy("col").orderBy("value"))
    rows = (found.where("value IS NOT NULL").distinct().withColumn("place", place)
            .where(F.col("place") <= most + 1).groupBy("col").agg(F.array_sort(F.collect_list("value")).alias("v")).collect())
    values = {r["col"]: r["v"] for r in rows}
    return {c: values.get(c, []) for c in cols if len(values.get(c, [])) <= most}


def distinct_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str,
                     levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """``count_{col}_{suffix}`` = number of distinct non-null values per group.

    The state of a column with few values (codes) is a long with a bit per
    value, joined by ``bit_or`` in the one partial aggregate. Columns with more
    values are counted in two levels: one row per (group, value) first, then
    rows per group, so a group with any number of values is never one task's set.
    ``levels`` gives values as text (all of them) of columns where they are known; the others are looked up."""
    known = dict(levels or {})
    known.update(code_levels(df, [c for c in cols if c not in known]))
    names = {c: f"count_{c}_{suffix}" for c in cols}

    def bits(c: str) -> Column:
        if not known[c]:
            return F.lit(0).cast("bigint").alias(names[c])
        place = F.array_position(F.array(*[F.lit(str(v)) for v in known[c]]), _as_text(df, c))
        bit = F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (place - 1).cast("int")))
        return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("bigint").alias(names[c])

    out = aggregate(df, keys, [bits(c) for c in cols if c in known] or [F.lit(0).alias("__none")])
    for c in cols:
        if c in known:
            continue
        once = df.select(*keys, c).distinct()
        counted = aggregate(once, keys, [F.count(c).alias(names[c])])
        other = counted.select(*[F.col(k).alias(f"__{k}") for k in keys], names[c])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        out = out.join(other, same, "left").drop(*[f"__{k}" for k in keys])
    return out.select(*keys, *[names[c] for c in cols])
