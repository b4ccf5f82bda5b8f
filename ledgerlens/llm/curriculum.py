"""Mixing sources to target weights along a time-varying curriculum, with
DataFrame operations only.

Every source has a target number of words and a weight schedule over training
time 0..1: a piecewise linear curve through knots (time, weight). The
schedule's integral up to time t, scaled to the target, is the demand of
the source up to t. The source's documents, in a hashed order and repeated
epoch after epoch, form one long run of words; the copy that starts at word c
of that run is trained at the time at which the demand reaches c: the
inverse of the integral, a square root inside one segment. Documents
come range-sorted by the position of their first copy, and
``copies`` gives one row per copy in training order.

Targets: sources in code point order, null last, take the given weights in
turn; the mix is as large as all documents together and is shared by
weight. No target passes ``max_repeats`` times its source; what is above is
shared again by weight until none is above.

A document is taken in whole copies: as many as whole epochs fit into the
target, and one more when the middle of its place lies before the rest of
the target. So a source's taken words differ from its target by half its
largest document at most, and no document is taken more than
``max_repeats`` times.

A source may hold any share of the rows: places are running sums in two
levels, buckets from the leading bits of the hash (about the square root of
the largest source's rows) and rows inside a bucket, and a row
meets its source's numbers by (source, bucket).

Defined results: null or empty text has size 0, is placed like any other
row, but is never taken; null is a source of its own; rows that share an id
but not the text are ordered by their text; equal rows are interchangeable;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import FULL_DIGITS, seeded_hash
from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Schedules, in turn like the weights: sources of little weight come late, those of much weight early.
SCHEDULES = (((0.0, 1.0), (0.5, 2.0), (1.0, 5.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 4.0), (0.25, 2.0), (1.0, 1.0)))
HASH_BITS = 4 * FULL_DIGITS


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _in_order(sources: DataFrame) -> DataFrame:
    """Add ``place``: 0, 1, 2, ... by source, null last, without one task for
    all sources."""
    spread = stored(sources.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("pid", F.spark_partition_id()), "mix-sources")
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)   # one row per partition
    start = spread.groupBy("pid").agg(F.count(F.lit(1)).alias("k")).select(
        "pid", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(W.partitionBy("pid").orderBy(F.col("source").asc_nulls_last()))
    return (spread.withColumn("own", own).join(start, "pid")
            .select(*sources.columns, (F.col("start") + F.col("own") - 1).alias("place")))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, place, weight, rows, source_size, target) of a table with
    ``source`` and ``size``. The driver sees three sums per round."""
    sources = _in_order(sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * max_repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, n_capped = None, -1
    while True:   # shares only grow from round to round, so a capped source stays capped
        capped = F.lit(False) if share is None else share >= cap
        held = sources.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("words"),
                           F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
                           F.count_if(capped).alias("n")).first()
        if held["n"] == n_capped or not held["open"]:
            break
        n_capped = held["n"]
        share = (F.col("weight") * (total - held["words"])).cast("double") / float(held["open"])
    target = cap.cast("double") if share is None else F.least(share, cap.cast("double"))
    return sources.select("source", "place", "weight", "rows", "source_size", target.alias("target"))


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0..1) of
    its whole. Weights are positive."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    area = share * F.lit(float(sum(areas)))
    out = None
    for i in reversed(range(len(areas))):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        inside = area - F.lit(float(sum(areas[:i])))
        root = F.sqrt(F.lit(float(w0 * w0)) + F.lit(2.0 * (w1 - w0) / (t1 - t0)) * inside)
        time = F.least(F.lit(float(t0)) + F.lit(2.0) * inside / (F.lit(float(w0)) + root), F.lit(float(t1)))
        out = time if out is None else F.when(area < F.lit(float(sum(areas[:i + 1]))), time).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, seed=2020, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document row, range-sorted by the position of its first copy
    (rows without a copy last): ``id``, ``source``, ``size``, ``source_size``,
    ``target``, ``positions`` (training time of every copy, ascending)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(text).alias("size"), F.xxhash64(text).alias("content"),
                               seeded_hash(f"mix{seed}", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")),
                   "mix-sizes")
    targets = stored(source_targets(sized, weights, max_repeats), "mix-targets")
    largest = targets.agg(F.max("rows")).first()[0] or 0
    bits = ceil(log2(max(1, largest)) / 2)
    dealt = sized.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    before = W.partitionBy("b_source").orderBy("b_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (dealt.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"))
              .agg(F.sum("size").alias("words"))
              .select("b_source", "b_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")))
    known = starts.join(targets, F.col("b_source").eqNullSafe(F.col("source"))).select(
        "b_source", "b_bucket", "start", "place", "source_size", "target")
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "content").rowsBetween(W.unboundedPreceding, -1)
    placed = (dealt.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(known, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
              .withColumn("at", F.col("start") + F.col("at")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    once_more = (F.col("at").cast("double") + F.col("size") / 2.0 < rest).cast("int")
    counted = (placed.withColumn("whole", whole)
               .withColumn("n", F.when(F.col("size") > 0, F.col("whole") + once_more).otherwise(0)))

    def position(epoch: int) -> Column:
        share = (F.col("at") + epoch * F.col("source_size")).cast("double") / F.col("target")
        turn = F.col("place") % len(schedules)
        time = time_of(share, schedules[0])
        for i, knots in list(enumerate(schedules))[1:]:
            time = F.when(turn == i, time_of(share, knots)).otherwise(time)
        return time

    times = F.array(*[position(e) for e in range(max_repeats)])
    result = counted.select("id", "source", "size", "source_size", "target",
                            F.when(F.col("n") > 0, F.slice(times, 1, F.col("n"))).otherwise(
                                F.array().cast("array<double>")).alias("positions"))
    return result.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "id")


def copies(mixed: DataFrame) -> DataFrame:
    """One row per copy in training order: ``id``, ``source``, ``size``,
    ``epoch`` (from 0) and ``position``."""
    each = mixed.select("id", "source", "size", F.posexplode("positions").alias("epoch", "position"))
    return each.orderBy("position", "id", "epoch")
