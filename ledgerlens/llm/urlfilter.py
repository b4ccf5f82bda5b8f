"""URL filter: rules first, then a ratio of two character language models.

Two variable-order Markov models over the bytes of a URL, one of accepted and
one of rejected URLs, are learned from the URLs that the rules decide. The
order runs from 0 to ``ORDER``: each longer context is interpolated with the
shorter one, weighted by how often it was seen. Counts cover every rule-decided URL
outside the calibration fold and are kept for each distinct context and context
with character, under a 64-bit key. The counts stay a distributed table: URLs are
dealt into chunks of about ``CHUNK_CHARS`` characters by a hash of the row, each
chunk asks for its distinct keys once, the keys meet their counts in a join, and a task scores a
chunk with the counts it asked for. Nothing that grows with the input reaches the driver or every task.
The score of a URL is the difference of the two log-likelihoods divided by its length; the
threshold is the one with the least balanced error on the calibration fold.

Defined results: null URLs and URLs without ``://`` have an empty host and
path and no rule; the model judges their text as it is (null: empty, score
0). With no accepted or no rejected URL to learn from, the score is 0 and the
threshold 0, so the verdict is ``allow``. Very long URLs are read whole, in pieces. Repeated rows count and are judged
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold, stored, with_row_id

ORDER = 4
BITS = 64          # of a key
STRENGTH = 4.0     # weight of the shorter context, in observations
CALIBRATION_FOLDS = 5
BATCH_BYTES = 1 << 17   # characters that a task takes apart at a time
CHUNK_CHARS = 1 << 18   # characters of the URLs that are scored together
BINS = 400         # of the score, from -2 to 2

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _batches(urls: list[bytes], order: int, limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(URL numbers, pieces) of at most ``limit`` characters together. A piece begins
    with the ``order`` characters before it; a long URL has several."""
    owners, pieces, held = [], [], 0
    for i, u in enumerate(urls):
        padded = b"\x00" * order + u + b"\x03"
        at = order
        while at < len(padded):
            piece = padded[at - order:at + limit - held]
            owners.append(i)
            pieces.append(piece)
            at += len(piece) - order
            held += len(piece) - order
            if held >= limit:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def _keys(pieces: list[bytes], bits: int, order: int):
    """Keys of every character of every piece, for each context length:
    (context, context with character), and the piece of each character."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(u) - order for u in pieces), np.int64, len(pieces))
    begin = np.cumsum(lengths + order) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    shift = np.uint64(64 - bits)
    context, out = np.zeros(len(at), np.uint64), []
    for k in range(order + 1):
        if k:
            context = (context + data[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        seed = np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        ctx = ((context ^ seed) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
        pair = (((context + data[at] * np.uint64(0x94D049BB133111EB)) ^ (seed << np.uint64(1)))
                * np.uint64(0xBF58476D1CE4E5B9)) >> shift
        out.append((ctx, pair))
    return out, np.repeat(np.arange(len(pieces)), lengths)


def _bytes(urls) -> list[bytes]:
    return [u.encode() if isinstance(u, str) else b"" for u in urls]


def _distinct_keys(pieces: list[bytes], bits: int, order: int) -> Iterator[pd.DataFrame]:
    """The distinct keys of both tables (pair 0: contexts, 1: contexts with character) and their occurrences."""
    keys = _keys(pieces, bits, order)[0]
    for table in (0, 1):
        key, n = np.unique(np.concatenate([k[table] for k in keys]), return_counts=True)
        yield pd.DataFrame({"pair": np.int32(table), "key": key.view(np.int64), "n": n})


def count_keys(urls: DataFrame, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """pair, key, n0, n1: counts of contexts and of contexts with their next
    character, per class, from every row of ``urls`` (url, accepted)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cls in (0, 1):
                own = _bytes(b["url"][b["accepted"] == bool(cls)])
                for _, pieces in _batches(own, order):
                    for found in _distinct_keys(pieces, bits, order):
                        yield found.assign(cls=np.int32(cls))

    return urls.mapInPandas(run, "pair int, key long, n long, cls int").groupBy("pair", "key").agg(
        *[F.sum(F.when(F.col("cls") == cls, F.col("n")).otherwise(F.lit(0))).alias(f"n{cls}") for cls in (0, 1)])


def as_tables(found: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``count_keys`` as (keys in order, counts [class, key]) of the two tables."""
    out = []
    for table in (0, 1):
        own = found[found["pair"] == table]
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(keys)
        out.append((keys[by], own[["n0", "n1"]].to_numpy(np.float32).T[:, by]))
    return out


def _counts(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Counts [class, asked key]; 0 for a key that was never counted."""
    keys, counts = table
    if not len(keys):
        return np.zeros((2, len(asked)), np.float32)
    once, back = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, once), len(keys) - 1)
    return (counts[:, at] * (keys[at] == once))[:, back]


def log_ratio(urls: list[bytes], tables, order: int = ORDER, bits: int = BITS, limit: int = BATCH_BYTES) -> np.ndarray:
    """Length-normalised log P(accepted model) - log P(rejected model)."""
    total = np.zeros(len(urls))
    for owners, pieces in _batches(urls, order, limit):
        keys, piece = _keys(pieces, bits, order)
        p = np.full((2, len(piece)), 1 / 256, np.float64)
        for ctx, pair in keys:
            p = (_counts(tables[1], pair) + STRENGTH * p) / (_counts(tables[0], ctx) + STRENGTH)
        total += np.bincount(np.asarray(owners)[piece], np.log(p[1]) - np.log(p[0]), len(urls))
    return total / [len(u) + 1 for u in urls]


def score_chunks(urls: DataFrame, counts: DataFrame, chars: int, order: int = ORDER, bits: int = BITS,
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``urls`` (stored; a column ``url`` and a unique ``_rid``) with its ``score``. ``chars`` are
    the characters of all URLs together; empty and null URLs score 0."""
    chunks = max(1, -(-chars // chunk_chars))
    dealt = urls.withColumn("chunk", F.pmod(F.xxhash64("_rid"), F.lit(chunks)))
    schema = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes) + ", score double"

    def ask(chunk: pa.Table) -> pa.Table:
        found = [k for _, pieces in _batches(_bytes(chunk["url"].to_pylist()), order) for k in _distinct_keys(pieces, bits, order)]
        keys = pd.concat(found)[["pair", "key"]].drop_duplicates()
        return pa.table({"chunk": np.full(len(keys), chunk["chunk"][0].as_py(), np.int64),
                         "pair": keys["pair"].to_numpy(), "key": keys["key"].to_numpy()})

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        own = _bytes(chunk["url"].to_pylist())
        ratio = np.where([len(u) > 0 for u in own], log_ratio(own, as_tables(found.to_pandas()), order, bits), 0.0)
        return chunk.drop_columns(["chunk"]).append_column("score", pa.array(ratio, pa.float64()))

    asked = dealt.select("chunk", "url").groupBy("chunk").applyInArrow(ask, "chunk long, pair int, key long")
    known = asked.join(counts, ["pair", "key"]).select("chunk", "pair", "key", "n0", "n1")
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                         host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(with_row_id(parts.withColumn("rule", rule).withColumn("rule_verdict", verdict)), "ruled-urls")
    accepted = F.col("rule_verdict") == "allow"
    tuning = fold(F.col("url"), CALIBRATION_FOLDS) == 0
    known = ruled.where("rule IS NOT NULL")
    learn = known.where(~tuning).select("url", accepted.alias("accepted"))
    chars = ruled.agg(F.sum(F.length("url"))).first()[0]
    classes = learn.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    threshold, scored = 0.0, ruled.withColumn("score", F.lit(0.0))
    if all(classes):
        scored = stored(score_chunks(ruled, stored(count_keys(learn), "url-counts"), chars or 0), "url-scores")
        threshold = calibrate(scored.where("rule IS NOT NULL").where(tuning).select(accepted.alias("accepted"), F.col("score").alias("s")))
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("rule_verdict", by_model).alias("verdict"), "score")


def calibrate(scored: DataFrame) -> float:
    """Bin edge with the least balanced error; ties go to the edge nearest zero."""
    at = F.least(F.greatest(F.floor((F.col("s") + 2) * BINS / 4), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(at.alias("b"), "accepted").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 x BINS rows
    count = np.zeros((2, BINS))
    for r in rows:
        count[int(r["accepted"]), r["b"]] = r["n"]
    if not count[0].sum() or not count[1].sum():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(count, axis=1)), axis=1)
    error = below[1] / count[1].sum() + 1 - below[0] / count[0].sum()
    edges = np.arange(BINS + 1) * 4 / BINS - 2
    return float(min(zip(np.round(error, 12), np.abs(edges), edges))[2])
