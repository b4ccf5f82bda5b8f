"""Audit of how filters interact: for every order in which the filters may run,
what each step removes, what earlier steps had removed already, what only
this filter would remove, and which labelled documents are lost.

One narrow base table holds a row per document (row number, part, label
flags); for each filter one table holds the row numbers of the documents that
fail it. Survivors of a prefix of filters are the base rows left over by
left-anti joins with the id tables; they depend on the set of the prefix's
filters alone, so the survivors of all 32 sets come from one pass that
meets each filter once: a row stays in every set so far and, unless the
filter's id table holds it, enters the same set with the filter added. A filter's own
failures are a left-semi join. What a step removes is the difference
of two survivor counts; what was removed earlier but fails the filter too
is its failures less those. All joins are on unique row numbers, so no key is
hot; only counts per part and set leave them.

The filters of ``text_filters`` (texts whole, null as empty, words maximal
runs without white space, case-sensitive): A fewer than 50 words; B distinct words below 65 % of
the words; C more than 5 % of the characters in A-Z; D holds one of
``#$%&*|``; E the text equals that of a smaller id. E keeps one first id
per distinct text and takes the other rows by an anti join on (text
digest, id), whatever the size of a group of copies.

Defined results: a null id is larger than every other; rows that repeat an id
and text are both the first of their text; a document whose label rows disagree is
good or toxic if any row says so; labels of unknown documents are ignored; a
null part is the empty string; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
COUNTS = ("kept", "good", "toxic")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that look at one text."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length(text),
            "D": text.rlike(SYMBOLS)}


def base_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """``rid``, ``id``, ``part``, ``good``, ``toxic``, ``digest`` and a flag per text filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text.alias("text"))
    split = plain.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    found = text_filters(F.col("text"), F.col("words"))
    numbered = stored(split.select(F.monotonically_increasing_id().alias("rid"), "id", "part",
                                   F.sha2("text", 256).alias("digest"), *[c.alias(f"fails_{k}") for k, c in found.items()]),
                      "audit-texts")
    rated = labels.groupBy(F.col("doc_id").alias("rated_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return numbered.join(rated, F.col("id") == F.col("rated_id"), "left").select(
        *numbered.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def repeated_texts(base: DataFrame) -> DataFrame:
    """Rows whose text is that of a smaller id."""
    first = base.groupBy(F.col("digest").alias("own")).agg(F.min("id").alias("first"))
    return base.join(first, (F.col("digest") == F.col("own")) & F.col("id").eqNullSafe(F.col("first")), "left_anti")


def failing_tables(base: DataFrame, names: str = "ABCD") -> dict[str, DataFrame]:
    """One stored id table per filter."""
    tables = {f: stored(base.where(f"fails_{f}").select(F.col("rid").alias("failed")), f"audit-fails-{f}") for f in names}
    tables["E"] = stored(repeated_texts(base).select(F.col("rid").alias("failed")), "audit-fails-E")
    return tables


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), F.count_if("good").alias("good"),
                                   F.count_if("toxic").alias("toxic"))


def survivors(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(part, set, kept, good, toxic): what is left after the filters of the
    set, whose bits follow the order of ``failing``. Parts without survivors have no row."""
    alive = rows.withColumn("set", F.lit(0))
    for bit, ids in enumerate(failing.values()):
        passed = alive.join(ids, F.col("rid") == F.col("failed"), "left_anti")
        alive = alive.unionByName(passed.withColumn("set", F.col("set") + (1 << bit)))
    return _counted(alive, "part", "set")


def failures(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(part, filter, fails): documents that fail each filter."""
    each = [_counted(rows.join(ids, F.col("rid") == F.col("failed"), "left_semi"), "part").select(
        "part", F.lit(name).alias("filter"), F.col("kept").alias("fails")) for name, ids in failing.items()]
    return reduce(DataFrame.unionByName, each)


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """One row per part, filter order and step; ``rows`` has ``rid``, ``part``,
    ``good`` and ``toxic``."""
    names = list(failing)
    n, full = len(names), (1 << len(names)) - 1
    left = stored(survivors(rows, failing), "audit-survivors")
    failed = stored(failures(rows, failing), "audit-failures")
    # per part one entry per set of filters and one per filter: fixed numbers, whatever the data
    by_set = left.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct(*COUNTS)))).alias("left"))
    by_filter = failed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filter", "fails"))).alias("failed"))

    def count(which: str, at: int) -> Column:
        return F.coalesce(F.try_element_at("left", F.lit(at))[which], F.lit(0))

    def removed_over_orders(bit: int) -> Column:
        """Removals by one filter, each set before it counted once per order that has it."""
        terms = []
        for s in range(full + 1):
            if not s >> bit & 1:
                orders = factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
                terms.append(orders * (count("kept", s) - count("kept", s | 1 << bit)))
        return reduce(Column.__add__, terms)

    per_part = by_set.join(by_filter, "part", "left").select(
        "part", *[F.array(*[count(c, s) for s in range(full + 1)]).alias(c) for c in COUNTS],
        F.array(*[F.coalesce(F.try_element_at("failed", F.lit(f)), F.lit(0)) for f in names]).alias("fails"),
        F.array(*[removed_over_orders(b) for b in range(n)]).alias("over_orders"))
    steps = [{"filter_order": "".join(names[i] for i in order), "step": k + 1, "bit": order[k],
              "before": sum(1 << i for i in order[:k]), "after": sum(1 << i for i in order[:k + 1]),
              "others": full ^ 1 << order[k]} for order in permutations(range(n)) for k in range(n)]
    layout = "array<struct<filter_order:string,step:int,bit:int,before:int,after:int,others:int>>"
    each = per_part.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), layout)))

    def lost(which: str) -> Column:
        return F.get(which, "before") - F.get(which, "after")

    return each.select("part", "filter_order", "step", F.get("kept", "after").alias("kept"), lost("kept").alias("removed"),
                       (F.get("fails", "bit") - lost("kept")).alias("redundant"),
                       (F.get("kept", "others") - F.get("kept", F.lit(full))).alias("unique_fails"),
                       lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
                       F.get("over_orders", "bit").alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole ``docs``."""
    base = stored(base_table(docs, labels), "audit-base")
    return audit(base.select("rid", "part", "good", "toxic"), failing_tables(base))
