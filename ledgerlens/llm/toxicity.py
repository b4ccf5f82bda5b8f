"""Toxicity scores from a bidirectional gated recurrent network with attention
pooling over character and word inputs, trained and run in numpy.

Inputs of a word: evidence of the word itself and of its character n-grams
(with word boundaries) for the toxic label, from counts over every labelled
row. Each distinct word and n-gram has its own counts, under a 64-bit key, in a
Spark aggregate that grows with the labelled rows. The tables that are broadcast
hold the keys with a log odds of ``MIN_EVIDENCE`` or more either way, and words
seen ``MIN_SEEN`` times; any other key is off by less than ``MIN_EVIDENCE`` when
it is taken for one never seen. The tables are counted in two halves; a training document is described by the other half's table, so that the
network never sees evidence that came from the document it learns from.

The network reads windows of ``WINDOW`` words. A text is scored on all its
windows, which overlap by ``OVERLAP`` words; the strongest window, the soft
maximum and the number of windows give the text's probability by a logistic
calibration. Network and calibration are fitted on bounded hash samples
of the labelled rows (``MAX_TRAIN``, ``MAX_CALIBRATE``) and on all their windows; of a
text with more than ``TRAIN_WINDOWS`` (some 25,000 words) those of the strongest
evidence in the whole text train, which bounds the memory of the one training task.
Counts and scores cover all rows and whole texts.

Defined results: null and wordless texts are one empty window, scored like any
other; rows without a label are not learned from; with only one class to
learn from every score is that class's label (0 if there is none); repeated
rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import bound_text_batches, stored

WINDOW, OVERLAP = 64, 16
HIDDEN = 8
MIN_EVIDENCE, MIN_SEEN = 0.25, 16    # what tables keep: |log odds| or times seen, at least
HALVES = [(0,), (1,), (0, 1)]
CELLS = ["c00", "c01", "c10", "c11"]    # counts by half and label
CHAR_ORDERS = (3, 5, 7)
PRIOR = 2.0                  # pseudo-counts that hold evidence back
MAX_TRAIN = (1200, 1800)     # toxic and other rows the network is fitted on
MAX_CALIBRATE = (1000, 3000)
TRAIN_WINDOWS = 512          # of one text; see module doc
STEPS, BATCH, RATE = 560, 64, 0.02
SEGMENT_CHARS, CARRY_CHARS = 1_000_000, 1_000
MAX_KNOWN = 150_000          # distinct words a task remembers
FLUSH_WORDS = 16_384         # of them, whose n-grams are worked out together
INPUTS = 3 + len(CHAR_ORDERS)

FIND = re.compile(r"\w+").findall


def segments(text: str, carry: bool = True) -> Iterator[str]:
    """A long text in parts of about a million characters, cut at blanks. With
    ``carry`` each repeats the end of the one before, so no window is lost; without it
    each word is in one part."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        cut = text.find(" ", at + SEGMENT_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        back = text.find(" ", cut - CARRY_CHARS, cut) if carry else -1
        at = cut if back < 0 else back
    yield text[at:]


def window_starts(n: int) -> np.ndarray:
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    last = n - WINDOW
    starts = np.arange(0, last, WINDOW - OVERLAP)
    return np.append(starts, last)


MIX64 = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_keys(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """64-bit key of each word; per n-gram order the keys and owners of the
    n-grams of the word with its boundaries marked."""
    if not words:
        return np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * len(CHAR_ORDERS), [np.zeros(0, np.int64)] * len(CHAR_ORDERS)
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    begin = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    placed = _mixed(codes + ((at - begin[owner] + 1).astype(np.uint64) << np.uint64(32)))
    own = _mixed(np.add.reduceat(placed, begin))
    keys, owners, room = [], [], ends[owner] - at
    for n in CHAR_ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n * int(MIX64) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ codes[k:k + len(h)]) * MIX64
            h ^= h >> np.uint64(32)
        ok = np.flatnonzero(room[:len(h)] >= n)
        keys.append(_mixed(h[ok]))
        owners.append(owner[ok])
    return own, keys, owners


class Table:
    """Values of the kept keys, in key order; 0 for every other key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order].astype(np.float32) for v in values]

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys), np.float32) for _ in self.values]
        asked, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[at] == asked
        return [np.where(hit, v[at], np.float32(0))[back] for v in self.values]


@dataclass
class Evidence:
    """Tables of words (evidence, how often seen) and of n-grams (evidence), by
    the halves they were counted in, and the counts [table, half, label]."""
    by_halves: dict[tuple[int, ...], tuple[Table, Table]]
    totals: np.ndarray

    def tables(self, halves: tuple[int, ...]) -> tuple[Table, Table]:
        return self.by_halves[halves]


def inputs(words: list[str], tables) -> np.ndarray:
    """Input vector of each word: its own evidence, how often it was seen, the
    strongest n-gram evidence per order, and the mean over all n-grams."""
    by_word, by_char = tables
    own, keys, owners = word_keys(words)
    out = np.zeros((len(words), INPUTS), np.float32)
    if not words:
        return out
    out[:, 0], out[:, 1] = by_word(own)
    found = np.split(by_char(np.concatenate(keys))[0], np.cumsum([len(k) for k in keys])[:-1])
    total, n = np.zeros(len(words)), np.zeros(len(words))
    for k, (z, o) in enumerate(zip(found, owners)):
        if len(z):
            first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            out[o[first], 2 + k] = np.maximum.reduceat(z, first)
            total += np.bincount(o, z, len(words))
            n += np.bincount(o, minlength=len(words))
    out[:, -1] = total / np.maximum(n, 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes of the network; arrays are [direction, ...]."""

    def __init__(self, rng: np.random.Generator):
        h, d = HIDDEN, INPUTS
        self.p = {"wx": rng.normal(0, 0.4, (2, d, 3 * h)), "b": np.zeros((2, 1, 3 * h)),
                  "u": rng.normal(0, 0.3, (2, h, 3 * h)), "a": rng.normal(0, 0.3, (2, h)),
                  "o": rng.normal(0, 0.3, (2, h)), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input part of the gates of each word: [word, direction, 3h]."""
        return np.stack([x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)], axis=1).astype(np.float32)

    def logits(self, ids: np.ndarray, lengths: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Window logits. ``ids`` [window, T] are rows of ``gates``."""
        w, steps = ids.shape
        h = HIDDEN
        table = gates.reshape(-1, 3 * h)                  # row 2 * id + direction
        u = self.p["u"]
        scores = np.empty((steps, w), np.float32)
        values = np.empty((steps, w), np.float32)
        scores[:], values[:] = 0, 0
        for d in (0, 1):
            state = np.zeros((w, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = table[2 * ids[:, t] + d]
                s = state @ u[d]
                zr = g[:, :2 * h] + s[:, :2 * h]
                np.tanh(zr * np.float32(0.5), out=zr)     # sigmoid(x) = (1 + tanh(x / 2)) / 2
                zr += 1
                zr *= np.float32(0.5)
                n = np.tanh(g[:, 2 * h:] + zr[:, h:] * s[:, 2 * h:])
                new = n + zr[:, :h] * (state - n)
                live = lengths > t
                state = new if live.all() else np.where(live[:, None], new, state)
                scores[t] += state @ self.p["a"][d]
                values[t] += state @ self.p["o"][d]
        scores[np.arange(steps)[:, None] >= np.maximum(lengths, 1)[None, :]] = -1e9
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        return (scores * values).sum(axis=0) / scores.sum(axis=0) + self.p["c"][0]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, owner: np.ndarray, label: np.ndarray,
                  weight: np.ndarray):
        """Loss and gradients for windows ``x`` [window, T, input] of documents
        ``owner``; a document's logit is the soft maximum over its windows."""
        w, steps, _ = x.shape
        h, p = HIDDEN, self.p
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        kept = []
        outs = np.zeros((2, steps, w, h), np.float32)
        for d in (0, 1):
            gates = x @ p["wx"][d] + p["b"][d]
            state, memory = np.zeros((w, h), np.float32), {}
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                s = state @ p["u"][d]
                g = gates[:, t]
                z, r = sigmoid(g[:, :h] + s[:, :h]), sigmoid(g[:, h:2 * h] + s[:, h:2 * h])
                n = np.tanh(g[:, 2 * h:] + r * s[:, 2 * h:])
                new = n + z * (state - n)
                memory[t] = (state, z, r, n, s[:, 2 * h:])
                state = new * mask[:, t:t + 1] + state * (1 - mask[:, t:t + 1])
                outs[d, t] = state
            kept.append(memory)
        score = np.einsum("dtwh,dh->wt", outs, p["a"]) - 1e9 * (1 - mask)
        alpha = np.exp(score - score.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        value = np.einsum("dtwh,dh->wt", outs, p["o"])
        logit = (alpha * value).sum(axis=1) + p["c"][0]
        docs = len(label)
        top = np.full(docs, -np.inf)
        np.maximum.at(top, owner, logit)
        e = np.exp(logit - top[owner])
        total = np.bincount(owner, e, docs)
        doc_logit = top + np.log(total)
        prob = sigmoid(doc_logit)
        loss = -(weight * (label * np.log(prob + 1e-9) + (1 - label) * np.log(1 - prob + 1e-9))).sum() / docs
        d_logit = ((weight * (prob - label) / docs)[owner] * e / total[owner]).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["c"][0] = d_logit.sum()
        d_value = alpha * d_logit[:, None]
        d_score = alpha * (value - (alpha * value).sum(axis=1, keepdims=True)) * d_logit[:, None]
        grad["o"] = np.einsum("wt,dtwh->dh", d_value, outs)
        grad["a"] = np.einsum("wt,dtwh->dh", d_score, outs)
        for d in (0, 1):
            carry = np.zeros((w, h), np.float32)
            d_gates = np.zeros((w, steps, 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                state, z, r, n, sn = kept[d][t]
                m = mask[:, t:t + 1]
                carry = carry + d_value[:, t:t + 1] * p["o"][d] + d_score[:, t:t + 1] * p["a"][d]
                own = carry * m
                dn = own * (1 - z) * (1 - n * n)
                dz = own * (state - n) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                ds = np.concatenate((dz, dr, dn * r), axis=1)
                d_gates[:, t] = np.concatenate((dz, dr, dn), axis=1)
                grad["u"][d] += state.T @ ds
                carry = carry * (1 - m) + own * z + ds @ p["u"][d].T
            grad["wx"][d] = np.tensordot(x, d_gates, ((0, 1), (0, 1)))
            grad["b"][d, 0] = d_gates.sum(axis=(0, 1))
        return loss, grad


def train(x: list[np.ndarray], lengths: list[np.ndarray], label: np.ndarray, seed: int = 7) -> Network:
    """``x[i]`` [window, WINDOW, input] are the windows of document i."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    ones = max(1, label.sum())
    weight = np.where(label == 1, len(label) / (2 * ones), len(label) / (2 * max(1, len(label) - ones)))
    step = 0
    while step < STEPS:
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            owner = np.repeat(np.arange(len(own)), [len(x[i]) for i in own])
            _, grad = net.gradients(np.concatenate([x[i] for i in own]), np.concatenate([lengths[i] for i in own]),
                                    owner, label[own].astype(np.float64), weight[own])
            step += 1
            rate = RATE * max(0.02, 1 - step / (STEPS + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


@dataclass
class Model:
    tables: tuple
    net: Network | None
    calibration: np.ndarray     # weights of strongest, soft mean, log windows, constant
    constant: float = 0.0       # the score if there was one class only


def scorer_of(model: Model) -> "Scorer":
    """The scorer of a broadcast model, kept with it from task to task."""
    if not hasattr(model, "scorer"):
        model.scorer = Scorer(model)
    return model.scorer


class Scorer:
    """Window logits of texts; remembers the gate inputs of words."""

    def __init__(self, model: Model):
        self.m = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = np.zeros((MAX_KNOWN, 2, 3 * HIDDEN), np.float32)    # row 0: padding; room is filled in place
        self.used = 1

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        if len(self.known) > MAX_KNOWN:
            self._clear()
        flat = list(chain.from_iterable(words))
        index = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(index < 0).tolist()
        new = list({flat[i] for i in missing})
        if new:
            base, made = self.used, self.m.net.project(inputs(new, self.m.tables))
            self.used += len(new)
            if self.used > len(self.gates):
                self.gates = np.concatenate((self.gates[:base], made))
            else:
                self.gates[base:self.used] = made
            self.known.update(zip(new, range(base, self.used)))
            index[missing] = [self.known[flat[i]] for i in missing]
        return index

    def summaries(self, texts: list[str]) -> np.ndarray:
        """[text, 3]: strongest window, soft mean over windows, log of their number."""
        tops, sums, counts = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))
        for part in self._parts(texts):
            logit, owner = self._windows([s for _, s in part])
            which = np.fromiter((i for i, _ in part), np.int64, len(part))[owner]
            np.maximum.at(tops, which, logit)
            sums += np.bincount(which, np.exp(np.clip(logit, -30, 30)), len(texts))
            counts += np.bincount(which, minlength=len(texts))
        return np.stack((tops, np.log(sums / counts), np.log(counts)), axis=1)

    @staticmethod
    def _parts(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        held, size = [], 0
        for i, t in enumerate(texts):
            for s in segments(t):
                if held and size + len(s) > ngrams.CHUNK_CHARS:
                    yield held
                    held, size = [], 0
                held.append((i, s))
                size += len(s) + 100
        if held:
            yield held

    def _windows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [FIND(s.lower()) for s in parts]
        ids = np.append(self._ids(words), 0)
        n = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(n) - n
        starts = [window_starts(k) for k in n]
        owner = np.repeat(np.arange(len(words)), [len(s) for s in starts])
        start = np.concatenate(starts) + base[owner]
        length = np.minimum(n[owner], WINDOW)
        logit = np.empty(len(start))
        order = np.argsort(length, kind="stable")          # short windows run fewer steps
        for at in range(0, len(order), 4096):
            own = order[at:at + 4096]
            steps = max(1, int(length[own[-1]]))
            where = start[own, None] + np.arange(steps)[None, :]
            inside = np.arange(steps)[None, :] < length[own, None]
            logit[own] = self.m.net.logits(np.where(inside, ids[np.minimum(where, len(ids) - 1)], 0), length[own], self.gates)
        return logit, owner

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if self.m.net is None:
            return np.full(len(texts), self.m.constant)
        s = np.concatenate((self.summaries(texts), np.ones((len(texts), 1))), axis=1)
        return sigmoid(s @ self.m.calibration)


def _counted(labelled: DataFrame) -> DataFrame:
    """(chars, key, c00, c01, c10, c11): counts by half and label of every
    distinct word and n-gram of all labelled rows (half, text, label)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {}

        def flush(half: int, label: int) -> Iterator[pd.DataFrame]:
            counter = seen.pop((half, label))
            ordered = sorted(counter)                   # words that begin alike share their n-grams
            for at in range(0, len(ordered), FLUSH_WORDS):
                words = ordered[at:at + FLUSH_WORDS]
                n = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
                own, chars, owners = word_keys(words)
                grams, back = np.unique(np.concatenate(chars), return_inverse=True)
                times = np.bincount(back, n[np.concatenate(owners)], len(grams)).astype(np.int64)
                for is_chars, k, c in ((False, own, n), (True, grams, times)):
                    yield pd.DataFrame({"chars": is_chars, "key": k.view(np.int64), "cell": np.int32(2 * half + label), "n": c})

        for b in batches:
            for half, label, text in zip(b["half"].tolist(), b["label"].tolist(), b["text"]):
                for s in segments(text, carry=False) if isinstance(text, str) else ():
                    counter = seen.setdefault((half, label), Counter())
                    counter.update(FIND(s.lower()))
                    if len(counter) > MAX_KNOWN:
                        yield from flush(half, label)
        for half, label in list(seen):
            yield from flush(half, label)

    return (labelled.mapInPandas(run, "chars boolean, key long, cell int, n long").groupBy("chars", "key")
            .agg(*[F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(F.lit(0))).alias(c) for i, c in enumerate(CELLS)]))


def count_evidence(labelled: DataFrame) -> Evidence:
    """Evidence of all labelled rows (half, text, label), counted exactly; what
    reaches the driver are the keys that some table keeps."""
    counted = stored(_counted(labelled), "evidence")
    totals = np.zeros((2, 2, 2))                                # table, half, label
    for r in counted.groupBy("chars").agg(*[F.sum(c).alias(c) for c in CELLS]).collect():
        totals[int(r["chars"])] = np.reshape([r[c] for c in CELLS], (2, 2))
    kept = []
    for halves in HALVES:
        for table in (0, 1):
            clean, toxic = (sum((F.col(CELLS[2 * h + label]) for h in halves), F.lit(0)) for label in (0, 1))
            t = totals[table][list(halves)].sum(axis=0)
            odds = F.log((toxic + PRIOR) / ((clean + toxic) * float(t[1] / max(1.0, t.sum())) + PRIOR))
            own = counted.where(F.col("chars") == bool(table)).select(
                F.lit(HALVES.index(halves) * 2 + table).alias("part"), "key", odds.cast("float").alias("odds"), (clean + toxic).alias("n"))
            # how often an n-gram was seen is no input
            kept.append(own.where((F.abs("odds") >= MIN_EVIDENCE) | ((F.col("n") >= MIN_SEEN) if not table else F.lit(False))))
    blocks = [[] for _ in kept]
    for i, part in enumerate(kept):
        for r in part.mapInPandas(_packed, "key binary, odds binary, seen binary").toLocalIterator():
            blocks[i].append((r["key"], r["odds"], r["seen"]))
    found = [Table(np.frombuffer(b"".join(k for k, _, _ in b), np.uint64), np.frombuffer(b"".join(z for _, z, _ in b), np.float32),
                   *([np.frombuffer(b"".join(n for _, _, n in b), np.float32)] if i % 2 == 0 else [])) for i, b in enumerate(blocks)]
    return Evidence({h: (found[2 * i], found[2 * i + 1]) for i, h in enumerate(HALVES)}, totals)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows as arrays, so that the driver never holds them one by one."""
    for b in batches:
        yield pd.DataFrame({"key": [b["key"].to_numpy(np.int64).tobytes()], "odds": [b["odds"].to_numpy(np.float32).tobytes()],
                            "seen": [(np.log1p(b["n"].to_numpy(float)) / 5).astype(np.float32).tobytes()]})


def _sample(rows: DataFrame, bounds: tuple[int, int], counts: dict[int, int]) -> DataFrame:
    """About ``bounds`` rows of the two labels, an even hash sample of each."""
    keep = F.lit(False)
    for label, bound in ((1, bounds[0]), (0, bounds[1])):
        share = min(1.0, bound / max(1, counts.get(label, 0)))
        keep = keep | ((F.col("label") == label) & (F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < int(share * (1 << 20))))
    return rows.where(keep)


def fit(labelled: DataFrame, seed: int = 7) -> Model:
    """``labelled``: key, text, label (0 or 1; others are left out)."""
    spark = labelled.sparkSession
    bound_text_batches(spark)
    rows = labelled.where("label in (0, 1) and text is not null").withColumn("label", F.col("label").cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(8)).cast("int"))
    rows = stored(rows.select("key", "text", "label", "part", (F.col("part") % 2).alias("half")), "labelled")
    sizes = {(r["c"], r["label"]): r["n"] for r in rows.groupBy((F.col("part") >= 6).alias("c"), "label")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    both = {label: sizes.get((True, label), 0) + sizes.get((False, label), 0) for label in (0, 1)}
    if not both[0] or not both[1]:
        return Model((), None, np.zeros(4), float(both[1] > 0))
    evidence = count_evidence(rows.select("half", "text", "label"))
    crossed = spark.sparkContext.broadcast([evidence.tables((1,)), evidence.tables((0,))])
    whole = evidence.tables((0, 1))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, label, half in zip(b["text"], b["label"], b["half"]):
                x = inputs([w for s in segments(text, carry=False) for w in FIND(s.lower())], crossed.value[half])
                taken = [x[s:s + WINDOW] for s in training_windows(x)]
                yield pd.DataFrame({"label": [label], "lengths": [[len(t) for t in taken]], "x": [np.concatenate(taken).reshape(-1)]})

    sample = _sample(rows.where("part < 6"), MAX_TRAIN, {k: sizes.get((False, k), 0) for k in (0, 1)})
    described = sample.select("text", "label", "half").mapInPandas(
        describe, "label int, lengths array<int>, x array<float>")          # bounded by MAX_TRAIN x TRAIN_WINDOWS
    got = described.repartition(1).mapInPandas(_train_task(seed), "name string, shape array<int>, value array<float>").toPandas()
    if got.empty:
        return Model((), None, np.zeros(4), both[1] / (both[0] + both[1]))
    net = Network(np.random.default_rng(seed))
    net.p = {n: np.asarray(v, np.float32).reshape(tuple(shape)) for n, shape, v in zip(got["name"], got["shape"], got["value"])}
    model = Model(whole, net, np.array([1.0, 0.0, 0.0, 0.0]))
    return Model(whole, net, _calibrate(rows, sizes, crossed, model))


def training_windows(x: np.ndarray) -> np.ndarray:
    """Starts of the windows that train, of a text with word inputs ``x``: all up
    to ``TRAIN_WINDOWS``, else those whose words have the most evidence for the label."""
    starts = window_starts(len(x))
    if len(starts) <= TRAIN_WINDOWS:
        return starts
    sums = np.concatenate(([0.0], np.cumsum(np.maximum(x[:, 0], x[:, 2:].max(axis=1)).clip(0), dtype=float)))
    evidence = sums[starts + WINDOW] - sums[starts]
    return np.sort(starts[np.argsort(-evidence, kind="stable")[:TRAIN_WINDOWS]])


def _train_task(seed: int):
    """Training on the bounded sample, in a task: only the parameters reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, lengths, label = [], [], []
        for b in batches:
            for y, flat, n in zip(b["label"], b["x"], b["lengths"]):
                n, at = np.asarray(n, np.int64), 0
                x = np.zeros((len(n), WINDOW, INPUTS), np.float32)
                flat = np.asarray(flat, np.float32).reshape(-1, INPUTS)
                for i, k in enumerate(n):
                    x[i, :k], at = flat[at:at + k], at + k
                xs.append(x)
                lengths.append(n)
                label.append(int(y))
        if len(set(label)) < 2:
            return
        order = sorted(range(len(xs)), key=lambda i: (label[i], xs[i].shape[0], float(xs[i].sum()), lengths[i].sum()))
        net = train([xs[i] for i in order], [lengths[i] for i in order], np.array([label[i] for i in order]), seed)
        yield pd.DataFrame({"name": list(net.p), "shape": [list(v.shape) for v in net.p.values()],
                            "value": [v.reshape(-1) for v in net.p.values()]})
    return run


def _calibrate(rows: DataFrame, sizes: dict, crossed, model: Model) -> np.ndarray:
    """Logistic weights on rows that the network was not fitted on, described by the other half's evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(model.net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(Model(crossed.value[h], shared.value, np.zeros(4))) for h in (0, 1)]
        for b in batches:
            for half, own in b.groupby("half"):
                s = scorers[int(half)].summaries(list(own["text"]))
                yield pd.DataFrame({"label": own["label"], "a": s[:, 0], "b": s[:, 1], "c": s[:, 2]})

    counts = {k: sizes.get((True, k), 0) for k in (0, 1)}
    sample = _sample(rows.where("part >= 6"), MAX_CALIBRATE, counts)
    got = sample.select("text", "label", "half").mapInPandas(
        run, "label int, a double, b double, c double").toPandas()              # bounded by MAX_CALIBRATE
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return np.array([1.0, 0.0, 0.0, 0.0])
    x = np.concatenate((got[["a", "b", "c"]].to_numpy(), np.ones((len(y), 1))), axis=1)
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, len(y) - y.sum()))
    w = np.array([0.5, 0.0, 0.0, 0.0])
    for _ in range(50):                                     # Newton steps with a small ridge
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 0.1 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(4)
        w = w - np.clip(np.linalg.solve(hess, g), -2, 2)
    return w


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column of probabilities for ``docs``."""
    bound_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(shared.value)
        for texts in batches:
            yield pd.Series(scorer.probabilities([t if isinstance(t, str) else "" for t in texts]), dtype="float64")

    return toxic(F.col(text_col))
