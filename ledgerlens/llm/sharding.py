"""Sharding by best-fit decreasing over indivisible groups of equal texts.

The size of a document is its text's UTF-8 bytes plus one, of a group the sum
over its documents. Groups of one size are interchangeable, so the packing
works on the histogram of group sizes (``bestfit``); distinct sizes add up to
at most the total, so the driver holds no more than sqrt(2 x total bytes)
rows. Documents find their shard by a join on the text's digest, which
Spark splits where one text owns many rows.

Defined results: a null text counts as the empty one (size 1, crc32 0, same
group); repeated rows are separate documents of one group; an empty table
gives no rows; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import Runs, pack_fixed, pack_into
from .common import rank_within, stored, with_row_id


def _meta(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))


def _assign(docs: DataFrame, id_col: str, text_col: str, plan) -> DataFrame:
    meta = stored(with_row_id(_meta(docs, id_col, text_col)), "shard-meta")
    groups = stored(with_row_id(meta.groupBy("digest").agg(F.sum("size").alias("gsize")), "_gid"), "shard-groups")
    counts = [(r["gsize"], r["n"]) for r in groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n")).collect()]
    n_groups = sum(c for _, c in counts)
    if not n_groups:
        return meta.withColumn("shard", F.lit(0))
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shard, _ = runs.value.place(b["gsize"].to_numpy(), b["_rank"].to_numpy())
            yield pd.DataFrame({"digest": b["digest"], "shard": shard})

    ranked = rank_within(groups, "gsize", "_gid", n_groups)
    placed = ranked.select("digest", "gsize", "_rank").mapInPandas(place, "digest string, shard int")
    return stored(meta.join(placed, "digest"), "shard-of")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly ``shards`` shards of nearly equal bytes: doc_id, size, text_crc32, shard, slot."""
    return _slots(_assign(docs, id_col, text_col, lambda counts: pack_into(counts, shards)))


def shard_by_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As few shards of at most ``capacity`` bytes as best fit finds (a larger group is alone)."""
    def plan(counts: list[tuple[int, int]]) -> Runs:
        return pack_fixed(counts, capacity)[0]
    return _slots(_assign(docs, id_col, text_col, plan))


def _slots(assigned: DataFrame) -> DataFrame:
    n = assigned.count()
    numbered = rank_within(assigned.select("_rid", "doc_id", "size", "text_crc32", "shard"), "shard", "_rid", n)
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("_rank").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard."""
    where = sharded.select(F.col("doc_id").alias("__doc"), F.col("shard").alias("__shard")).distinct()
    (docs.join(where, docs[id_col].eqNullSafe(F.col("__doc")), "left").drop("__doc")
     .withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path))
