"""Benchmark decontamination with DataFrame operations only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A
window is ``n`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window. Every window position of every document
is looked up in the set of benchmark windows. The lookup compares the whole
window text, so a match needs no further check.

The window set is broadcast when its measured size, item lists included, is below
``broadcast_bytes``; a larger one is joined by a shuffle on the window text.

Defined results: a null or wordless text has no words and no hits; a null
``item_id`` contributes hits but is not listed among the items; repeated
document rows each get their own (equal) row; repeated benchmark rows count
once; an empty table on either side gives documents without hits; other
columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _window_text(w: str, at: str, length: str) -> Column:
    return F.expr(f"concat_ws(' ', slice({w}, {at} + 1, {length}))")


def item_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: ``window``, ``len`` and the items it occurs in."""
    tokens = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    sized = tokens.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = sized.select("item", "w", "len", F.explode_outer(
        F.expr("if(len > 0, sequence(0, size(w) - len), array())")).alias("at")).where("at is not null")
    return (at.select("item", "len", _window_text("w", "at", "len").alias("window"))
            .groupBy("window", "len").agg(F.collect_set("item").alias("items")))


def row_bytes() -> Column:
    """Bound of the bytes of a row of ``item_windows`` in memory: its window and all its items."""
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda held, x: held + F.length(x.cast("string")) * 2 + 24)
    return F.length("window") * 2 + ids + 64


def window_hits(docs: DataFrame, windows: DataFrame, lengths: list[int], broadcast: bool,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, key, at, len, items): the window at word ``at`` of the document
    is a benchmark window. ``key`` is a hash of the text and tells apart rows
    that share an id but not the text."""
    tokens = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"),
                         words(F.col(text_col)).alias("w"))
    # explode_outer: a plain explode makes the optimizer add a filter on its
    # argument, which would split every text a second time
    each = tokens.select("doc", "key", "w", F.explode_outer(F.array(*[F.lit(x) for x in lengths])).alias("len"))
    at = each.select("doc", "key", "w", "len", F.explode_outer(
        F.expr("if(size(w) >= len, sequence(0, size(w) - len), array())")).alias("at"))
    probe = at.select("doc", "key", "at", "len", _window_text("w", "at", "len").alias("window"))
    right = windows.withColumnRenamed("len", "wlen")
    right = F.broadcast(right) if broadcast else right.hint("merge")
    return (probe.join(right, "window").where("len = wlen and at is not null")
            .select("doc", "key", "at", "len", "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: ``doc``, ``key`` (hash of the text), ``n_words``,
    ``spans`` (sorted word positions that are hit) and ``items`` (sorted ids as text)."""
    windows = stored(item_windows(benchmark, n), "bench-windows")
    sizes = windows.groupBy("len").agg(F.sum(row_bytes()).alias("bytes")).collect()  # at most n rows
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"),
                       F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    nothing = [F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")]
    if not sizes:
        return base.select("*", *nothing)
    hits = window_hits(docs, windows, sorted(r["len"] for r in sizes),
                       sum(r["bytes"] for r in sizes) <= broadcast_bytes, id_col, text_col)
    per_doc = (hits.dropDuplicates(["doc", "key", "at", "len"]).groupBy("doc", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(at, at + len - 1)"))))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    per_doc = per_doc.select(F.col("doc").alias("hdoc"), F.col("key").alias("hkey"), "spans",
                             F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    joined = base.join(per_doc, F.col("doc").eqNullSafe(F.col("hdoc")) & (F.col("key") == F.col("hkey")), "left")
    return joined.select("doc", "key", "n_words",
                         F.coalesce("spans", F.array().cast("array<int>")).alias("spans"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                     text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; all columns as they are."""
    windows = stored(item_windows(benchmark, n), "bench-windows")
    sizes = windows.groupBy("len").agg(F.sum(row_bytes()).alias("bytes")).collect()
    if not sizes:
        return docs
    hits = window_hits(docs, windows, sorted(r["len"] for r in sizes),
                       sum(r["bytes"] for r in sizes) <= broadcast_bytes, id_col, text_col)
    bad = hits.select(F.col("doc").alias("__hit_doc"), F.col("key").alias("__hit_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__hit_doc")) & (F.xxhash64(F.col(text_col)) == F.col("__hit_key"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                 text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, clean_text): the document's words without those inside a benchmark
    window, joined by single spaces; null texts stay null."""
    found = contamination(docs, benchmark, n, id_col, text_col, broadcast_bytes)
    hit = found.where(F.size("spans") > 0).select("doc", "key", "spans").distinct()
    own = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("own_text"))
    joined = own.join(hit, F.col("own").eqNullSafe(F.col("doc")) & (F.xxhash64("own_text") == F.col("key")), "left")
    kept = F.expr("filter(w, (x, i) -> not array_contains(spans, i))")
    return (joined.withColumn("w", words(F.col("own_text")))
            .select(F.col("own").alias("doc"), F.when(F.col("spans").isNull(), F.col("own_text"))
                    .otherwise(F.array_join(kept, " ")).alias("clean_text")))
