"""Keyed hashes that give the same numbers in Spark and in plain SQL engines.

A hash is the leading ``digits`` hex characters of ``md5`` over the
concatenated text, read as an unsigned integer. With 15 digits (60 bits)
it fits a ``bigint``; the same value is ``('0x' || substr(md5(t), 1, 15))::bigint``
in DuckDB. All randomness in the engine (splits, draws, shuffles) comes
from these hashes, so results repeat exactly for a given seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_DIGITS = 15  # 60 bits: fits a signed bigint


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def md5_int(*parts, digits: int = FULL_DIGITS) -> Column:
    """Integer from the first ``digits`` hex characters of md5(concat(parts)).
    ``parts`` are column names, Columns, or literal text wrapped in ``F.lit``."""
    text = F.concat(*[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def key_text(*cols, sep: str = "_") -> Column:
    """``c1 || sep || c2 || ...`` (null if any part is null, as in SQL concat)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_text(c))
    return F.concat(*parts)


def seeded_hash(seed, *cols, digits: int = FULL_DIGITS) -> Column:
    """Hash of ``'<seed>:' || c1 || '_' || c2 ...``."""
    return md5_int(F.lit(f"{seed}:"), key_text(*cols), digits=digits)


def percent_bucket(*cols, digits: int = 8) -> Column:
    """0..99 bucket of the unseeded key text ``c1_c2`` (the fixture's ``b``)."""
    return md5_int(key_text(*cols), digits=digits) % 100
