"""Column-level operators: safe casts, flags, code suffixes, one-hot levels,
keys and label arithmetic. Every helper returns Columns or applies one
projection, so a chain of them collapses into a single ``Project`` inside
whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import key_text

# The pattern that takes the number after the first underscore
# of a code such as ``entity_3``; ``Yes`` is the only true flag text.
SUFFIX_PATTERN = r"_(\d+)"
YES = "Yes"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_float(c) -> Column:
    """32-bit float; text that is not a number becomes null (never an error)."""
    return _c(c).try_cast("float")


def to_int(c) -> Column:
    """Integer through a double, so ``'3.0'`` and ``'3.7'`` give 3 (truncation)
    and ``''`` gives null."""
    return _c(c).try_cast("double").try_cast("int")


def cast_numeric(df: DataFrame, cols: Iterable[str], fl: bool = True) -> DataFrame:
    """Cast ``cols`` to float (``fl``) or int in place, in one projection."""
    conv = to_float if fl else to_int
    return df.withColumns({c: conv(c) for c in cols})


def yes_no(c) -> Column:
    return F.when(_c(c) == YES, 1).otherwise(0)


def yes_no_binary(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Exact, case-sensitive ``'Yes'`` → 1; anything else, null included → 0."""
    return df.withColumns({c: yes_no(c) for c in cols})


def code_suffix(c) -> Column:
    """Digits after the first underscore; ``''`` without a match, null for null."""
    return F.regexp_extract(_c(c), SUFFIX_PATTERN, 1)


def split_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: code_suffix(c) for c in cols})


def code_number(c, fl: bool = True) -> Column:
    """Suffix read as a number: int, then float when ``fl`` (as the feature
    tables use it); no suffix → null."""
    n = to_int(code_suffix(c))
    return n.cast("float") if fl else n


def period_number(df: DataFrame, src: str = "period", dst: str = "period2") -> DataFrame:
    """Copy ``src`` to ``dst`` and keep its numeric suffix as a float."""
    return df.withColumn(dst, to_float(code_suffix(src)))


def one_hot_columns(c, levels: Sequence, prefix: str) -> list[Column]:
    """``prefix{k}`` = 1 when ``c == k`` else 0 (null → 0) for each level."""
    col = _c(c)
    return [F.when(col == k, 1).otherwise(0).alias(f"{prefix}{k}") for k in levels]


def one_hot(df: DataFrame, c: str, levels: Sequence, prefix: str | None = None) -> DataFrame:
    return df.select("*", *one_hot_columns(c, levels, prefix if prefix is not None else c))


def composite_key(df: DataFrame, cols: Sequence[str] = ("ID", "period"), name: str = "key",
                  sep: str = "_") -> DataFrame:
    """String key ``ID_period``; kept as an output column only (joins use the
    columns themselves, which cannot collide)."""
    return df.withColumn(name, key_text(*cols, sep=sep))


def columns_except(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    excl = set(exclude)
    return [c for c in df.columns if c not in excl]


def sorted_difference(cols: Iterable[str], remove: Iterable[str]) -> list[str]:
    """Sorted, unique names in ``cols`` and not in ``remove``."""
    return sorted(set(cols) - set(remove))


def binary_target(label) -> Column:
    return F.when(_c(label) == 0, 0).otherwise(1)


def score_to_class(c) -> Column:
    """Round a score to a class, half to even (2.5 → 2)."""
    return F.bround(_c(c), 0).cast("int")


def two_stage_decision(binary_pred, multi_pred, shift: int = 1) -> Column:
    """0 where the binary stage says 0, else the stage-2 class plus ``shift``."""
    return F.when(_c(binary_pred) == 0, F.lit(0)).otherwise(_c(multi_pred) + shift).cast("int")
