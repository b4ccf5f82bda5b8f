"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    survive lost executors without repeating the work above, and every
    evaluation sees the same rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = "8m"


def bound_text_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in Arrow batches of about ``TEXT_BATCH``
    at most, not of 10,000 rows of any length: a task holds a batch several times
    over, on both sides of the pipe. A setting of the session, since a frame reads
    it when it runs, after its operator has returned; a caller's own value stays.
    No result depends on it."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, TEXT_BATCH)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Pure ASCII texts take
    the built-in ``lower``, which is the same there and much cheaper."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n`` (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A unique number per row; only stable once the result is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def rank_within(df: DataFrame, by: str, row_id: str, n_rows: int, per_bucket: int = 1000) -> DataFrame:
    """Add ``_rank``: 0, 1, 2, ... inside each value of ``by``, however many
    rows one value has. Rows are dealt into hashed buckets; a row's rank is
    its place in (value, bucket) plus the sizes of the value's earlier
    buckets, so a value with a third of all rows is spread over many tasks.
    ``df`` must be stored (it is read twice) and ``row_id`` unique in it."""
    buckets = max(1, n_rows // per_bucket)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(row_id), F.lit(buckets)))
    before = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (dealt.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    placed = dealt.withColumn("_place", F.row_number().over(W.partitionBy(by, "_bucket").orderBy(row_id)))
    return (placed.join(offsets, [by, "_bucket"])
            .withColumn("_rank", F.col("_before") + F.col("_place") - 1)
            .drop("_bucket", "_before", "_place"))


def text_chunks(texts: list[str], max_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts holding about ``max_chars``
    characters together (one text at least), so that the working memory of a
    task does not depend on how many long texts a batch has."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > max_chars:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
