"""Null handling: constant fill, mean imputation per split, row and column drops."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.materialize import stage

_FLOATING = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace null (and NaN) with 0 in numeric columns; text is untouched."""
    return df.fillna(0, subset=list(cols) if cols is not None else None)


def clean_doubles(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``cols`` as doubles (unreadable text is null) with NaN turned into
    null, in one projection. Written as SQL text: one JVM call for hundreds of columns."""
    wanted = set(cols)
    return df.selectExpr(*[f"nanvl(try_cast(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" if c in wanted else f"`{c}`"
                           for c in df.columns])


def column_means(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """One aggregation: the mean of every double column (per ``by`` value)."""
    means = [f"avg(`{c}`) AS `{c}`" for c in cols]
    return df.groupBy(by).agg(*[F.expr(m) for m in means]) if by else df.selectExpr(*means)


def known_means(clean: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The mean of every column that has one (NaN where infinities of both signs meet)."""
    row = column_means(clean, cols).first()
    return {c: row[c] for c in cols if row[c] is not None}


def fill_with_means(clean: DataFrame, cols: Sequence[str], fitted_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Fill null doubles with the means of ``fitted_on`` (``clean`` itself by
    default), which are one row, in a single projection. Also returns the
    columns that had a mean."""
    means = known_means(fitted_on if fitted_on is not None else clean, cols)
    return (clean.fillna(means) if means else clean), [c for c in cols if c in means]


def impute_mean(df: DataFrame, cols: Sequence[str], by: str | None = None, fit_on=None) -> DataFrame:
    """Cast ``cols`` to double and fill their nulls/NaNs with the column's mean.

    With ``by`` the mean is that of the row's own split (rows with a null
    split form a split too); with ``by`` and ``fit_on`` all rows get the means
    of the split ``fit_on``. The cleaned input is written once to the shared folder, so
    that the aggregate and the fill read it instead of computing it twice;
    the per-split means stay distributed and are joined."""
    cols = list(cols)
    clean = stage(clean_doubles(df, cols), "impute")
    if not by or fit_on is not None:
        part = clean if not by else clean.where(F.col(by) == F.lit(fit_on))
        return fill_with_means(clean, cols, part)[0]
    means = column_means(clean, cols, by).toDF("__by", *[f"__mean_{c}" for c in cols])
    joined = clean.join(means, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.selectExpr(*[f"coalesce(`{c}`, `__mean_{c}`) AS `{c}`" if c in set(cols) else f"`{c}`"
                               for c in clean.columns])


def drop_incomplete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows holding a null (or NaN) in any column of ``subset`` (all by default)."""
    return df.dropna(how="any", subset=list(subset) if subset is not None else None)


def drop_empty_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Remove columns that are null (or NaN) on every row. One global
    aggregate of non-null counts, a single row, decides the columns."""
    keep = set(keep)
    cands = [f for f in df.schema.fields if f.name not in keep]
    if not cands:
        return df

    def present(f):
        c = F.col(f.name)
        if isinstance(f.dataType, _FLOATING):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        return F.count(c).alias(f.name)

    counts = df.agg(*[present(f) for f in cands]).first()
    empty = {f.name for f in cands if counts[f.name] == 0}
    return df.select(*[c for c in df.columns if c not in empty])
