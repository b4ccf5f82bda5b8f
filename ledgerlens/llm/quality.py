"""Quality selection by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, ordered
thresholds cut its score into grades: P(grade >= k) = sigmoid(s - theta_k). The
features are relative frequencies of hashed character n-grams and hashed
shape words (bucketed ratios of distinct words and of repeats, and length). The fit uses a bounded sample of rated rows (``MAX_RATED``, an even
hash sample over each grade); every text is scored whole.

Defined results: null texts, and texts without a word, have expected grade 0
and tail probability 0; rows without a rating are not learned from; repeated
ratings of a document count each; with fewer than two grades to learn from,
every text with a word has the one grade (0 if none) and tail probability 1;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import bound_text_batches

ORDERS = (3,)
BITS = 12
SHAPE = 256                 # further bins for shape words
MAX_RATED = 4000            # rated rows that the fit uses
STEPS, RATE, DECAY = 300, 0.05, 1e-3
SCALE = 40.0                # relative frequencies are small numbers
HOLD = 50                   # n-grams of no weight added to every text: few n-grams say little
SHAPE_SCALE = 3.0


def shape_bins(text: str) -> list[int]:
    """Bins of the shape words of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return []
    size = min(7, n.bit_length())
    distinct = len(set(words)) / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    out = [f"size{size}", f"distinct{size}:{int(distinct * 10)}", f"all:{int(distinct * 10)}",
           f"repeat{int(repeats * 10)}", f"repeats{repeats > 0.1}", f"many{repeats > 0.3}"]
    return [(1 << BITS) + crc32(w.encode()) % SHAPE for w in out]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray   # of grade >= 1, 2, ...; empty: a single grade
    lowest: int = 0

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= lowest + k), k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -40, 40)))


def linear_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    w = weights[:1 << BITS].astype(np.float32)
    for segments in ngrams.chunks(texts, max(ORDERS) - 1):
        bins, owner = ngrams.hashed(segments, ORDERS, BITS)
        which = np.fromiter((i for i, _, _ in segments), np.int64, len(segments))
        np.add.at(total, which, np.bincount(owner, w[bins], len(segments)))
        np.add.at(n, which, np.bincount(owner, minlength=len(segments)))
    out = SCALE * total / (n + HOLD)
    for i, t in enumerate(texts):
        for b in shape_bins(t):
            out[i] += SHAPE_SCALE * weights[b]
    return out


def features(text: str) -> np.ndarray:
    x = np.zeros((1 << BITS) + SHAPE, np.float32)
    for segments in ngrams.chunks([text], max(ORDERS) - 1):
        x[:1 << BITS] += np.bincount(ngrams.hashed(segments, ORDERS, BITS)[0], minlength=1 << BITS)
    x *= SCALE / (x.sum() + HOLD)
    for b in shape_bins(text):
        x[b] += SHAPE_SCALE
    return x


def fit_ordinal(x: np.ndarray, grade: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient steps (Adam) on the mean
    negative log-likelihood of the cumulative-link model."""
    n, d = x.shape
    w, first, gaps = np.zeros(d), 0.0, np.zeros(max(0, levels - 2))   # theta = first, first + exp(gap) ...
    params = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, STEPS + 1):
        w, first, gaps = params[:d], params[d], params[d + 1:]
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        tail = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - theta[None, :], -30, 30)))
        edges = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-9)
        up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
        g_s = -(up - down) / n                       # by the score
        g_theta = np.zeros(levels + 1)
        np.add.at(g_theta, grade, up / n)
        np.add.at(g_theta, grade + 1, -down / n)
        g_theta = g_theta[1:levels]
        g_gaps = np.exp(gaps) * np.cumsum(g_theta[::-1])[::-1][1:]
        g = np.concatenate((x.T @ g_s.astype(np.float32) + DECAY * w, [g_theta.sum()], g_gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    theta = params[d] + np.concatenate(([0.0], np.cumsum(np.exp(params[d + 1:]))))
    return params[:d], theta


def rated_sample(rated: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """At most about ``max_rated`` rows of (key, text, grade): an even hash
    sample of each grade, the same share of the bound for every grade."""
    known = rated.where("grade is not null and text is not null")
    sizes = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max_rated // max(1, len(sizes))
    keep = F.lit(False)
    for grade, n in sizes.items():
        part = min(1.0, share / n)
        keep = keep | ((F.col("grade") == grade) & (F.pmod(F.xxhash64(F.lit("rated"), "key"), F.lit(1 << 20)) < int(part * (1 << 20))))
    return known.where(keep)


def fit(rated: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """``rated``: key, text, grade (small whole numbers)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [features(t) for t in b["text"]]
            at = [np.flatnonzero(x) for x in rows]
            yield pd.DataFrame({"grade": b["grade"], "at": at, "x": [x[i] for x, i in zip(rows, at)]})

    sample = rated_sample(rated, max_rated).select("text", F.col("grade").cast("int").alias("grade"))
    got = sample.mapInPandas(run, "grade int, at array<int>, x array<float>").toPandas()  # bounded by max_rated
    if got.empty:
        return Model(np.zeros((1 << BITS) + SHAPE), np.zeros(0), 0)
    x = np.zeros((len(got), (1 << BITS) + SHAPE), np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["x"])):
        x[i, at] = v
    values, grade = np.unique(got["grade"].to_numpy(), return_inverse=True)
    if len(values) < 2:
        return Model(np.zeros(x.shape[1]), np.zeros(0), int(values[0]))
    return Model(*fit_ordinal(x, grade, len(values)), int(values[0]))


def grade_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column struct(expected, tail): the expected grade above the lowest, and
    the probability of more than the lowest grade."""
    bound_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        own = [t if isinstance(t, str) else "" for t in texts]
        m = shared.value
        worded = np.fromiter((bool(t) and not t.isspace() for t in own), bool, len(own))
        if not len(m.thresholds):
            return pd.DataFrame({"expected": np.where(worded, float(m.lowest), 0.0), "tail": worded * 1.0})
        tails = m.tails(linear_scores(own, m.weights))
        return pd.DataFrame({"expected": np.where(worded, m.lowest + tails.sum(axis=1), 0.0),
                             "tail": np.where(worded, tails[:, 0], 0.0)})

    return grade(F.col(text_col))
