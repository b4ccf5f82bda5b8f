"""Exact top-k inner products by term-at-a-time accumulation.

Every vector component is a term, a vector its sparse row of (term, weight).
Candidates are dealt into blocks by a hash of their id, queries likewise; a
task gets one block of each, inverts the candidates into postings, and for
every term scatters weight x posting into a dense score array per query.
The best k of a block are selected by partition, and the blocks' selections
are merged by rank. Block sizes bound a task's memory; nothing is sampled or
pruned and nothing is broadcast.

Defined results: weights are floor(256 * x) of the component as double, of any size: where
products could pass a long, a block is scored in whole numbers of Python.
Ranks go by the exact score; a score beyond a long is returned as the long nearest to it.
Vectors that are null or hold a null or non-finite component take no part,
neither as query nor as candidate; a query does not find itself (rows that
repeat an id are that same vector's row and are not found either); missing
trailing components count as zero; ties go to the smaller id; with fewer than
k candidates all are returned; no queries or no candidates give no rows;
other columns are ignored.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 512
SCHEMA = "query_id long, vec_id long, score long, beyond string"
LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(rows: pd.Series) -> np.ndarray:
    """Weights, a row per vector: long, or whole numbers of any size where a long is too small."""
    x = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    if np.abs(x).max(initial=0) < 2.0 ** 52:
        return np.floor(x * 256).astype(np.int64)
    out = np.zeros(x.shape, object)
    out[:] = [[floor(v * 256) if abs(v) < 2.0 ** 52 else int(v) * 256 for v in r] for r in x.tolist()]
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as long if no score can pass it, else both as whole numbers of any size."""
    top = [int(np.abs(m).max(initial=0)) for m in (q, c)]
    small = top[0] * top[1] * min(q.shape[1], c.shape[1]) <= LONG.max
    small &= max(top) <= LONG.max
    return tuple(m.astype(np.int64 if small else object) for m in (q, c))


def _beyond(score: int) -> str:
    """Orders scores that share one end of a long: later in byte order is higher."""
    if LONG.min < score <= LONG.max:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    digits = "".join(chr(ord("9") - int(d) + ord("0")) for d in digits)
    return f"{99999 - len(digits):05d}{digits}"


def block_top_k(query_ids, q: np.ndarray, cand_ids, c: np.ndarray, k: int):
    """Best ``k`` of one candidate block for every query of one query block.
    ``cand_ids`` ascend, so the smaller position is the smaller id."""
    scores = np.zeros((len(query_ids), len(cand_ids)), q.dtype)
    for term in range(min(q.shape[1], c.shape[1])):
        posting = np.flatnonzero(c[:, term])
        asking = np.flatnonzero(q[:, term])
        if len(posting) == 0 or len(asking) == 0:
            continue
        add = q[asking, term][:, None] * c[posting, term][None, :]
        if len(posting) == len(cand_ids) and len(asking) == len(query_ids):
            scores += add
        else:
            scores[np.ix_(asking, posting)] += add
    own = query_ids[:, None] == cand_ids[None, :]
    for i in range(len(query_ids)):
        row, free = scores[i], np.flatnonzero(~own[i])
        if len(free) > k:
            bar = np.partition(row[free], len(free) - k)[len(free) - k]
            over, level = free[row[free] > bar], free[row[free] == bar]
            free = np.concatenate((over, level[:k - len(over)]))
        yield i, free, row[free]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of every query row."""
    rows = stored(vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("w"),
        F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null"), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).first()
    n_c, n_q = -(-max(1, size["n"]) // candidate_block), -(-max(1, size["m"]) // query_block)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # each query block meets each candidate block once
    cand = rows.select("id", "w", block(n_c).alias("cb")).select("id", "w", "cb", every(n_q).alias("qb"))
    ask = (rows.where("q").dropDuplicates(["id", "w"]).select("id", "w", block(n_q).alias("qb"))
           .select("id", "w", "qb", every(n_c).alias("cb")))

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"query_id": none, "vec_id": none, "score": none, "beyond": none.astype(str)})
        candidates = candidates.sort_values("id", kind="stable")
        qid, cid = queries["id"].to_numpy(), candidates["id"].to_numpy()
        q, c = _exact(_matrix(queries["w"]), _matrix(candidates["w"]))
        found = list(block_top_k(qid, q, cid, c, k))
        score = np.concatenate([s for _, _, s in found])
        beyond = [_beyond(s) for s in score] if score.dtype == object else [""] * len(score)
        return pd.DataFrame({"query_id": np.concatenate([np.repeat(qid[i], len(at)) for i, at, _ in found]),
                             "vec_id": np.concatenate([cid[at] for _, at, _ in found]),
                             "score": np.clip(score, LONG.min, LONG.max).astype(np.int64), "beyond": beyond})

    best = ask.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb")).applyInPandas(meet, SCHEMA)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
