"""Gradient boosted trees that grow round by round on Spark.

Rows are binned once (quantile thresholds, at most ``BINS`` bins a feature) and
written as blocks, which all boostings on the same rows read; which rows and classes a boosting
takes of them says its ``Target``. Features of few bins share a byte (``Packing``): one pass over a
pack adds up the histograms of all its features, which are its margins.
Every step is one job over the blocks: tasks add the trees that the stored margins
do not hold yet, take gradient and curvature of the loss (logistic for two
classes, joint softmax with one tree per class and round for more), and send one
histogram per (class, node). Of two sibling nodes only the one with less in it is added up; the
other one is their parent's histogram less that. The driver gets one histogram of a few
thousand cells per task and node, or where these come to more than ``GATHER`` bytes, per node; it keeps those of the
nodes that may still be split, and finds their splits. A leaf's
value is -G / (H + l2). Margins are written anew every ``REBASE`` rounds.

A row drawn many times is one row with a multiplicity: it weighs
gradients and curvatures, and subsampling thins the multiplicity by a binomial
draw (seeded by round and stored block), so that without subsampling the trees are
those of the copied rows.

Held-out blocks report their wrong rows and loss in the first job of the next
round (without ``patience``, where no stop waits for it, once all rounds are built), so boosting stops ``patience`` rounds after its best round without a fit
beyond that, and the result is the trees up to the best round.

Growth is by level, or best first with ``max_leaves``: the leaf whose split
gains most is split next. ``level_columns`` draws the columns of every
(round, class, level) anew."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.materialize import drop_staged, stage

BINS = 32
BLOCK_ROWS = 8192
PACK = 256               # cells of a pack of features: a byte
LOOKUP = 8               # splits of a tree up to which leaves are looked up by the outcomes of all its splits
GATHER = 16 << 20        # bytes of partial histograms that the driver takes from the tasks of one job
REBASE = 8
QUANTILE_ERROR = 0.005
MIN_GAIN = 1e-9
NO_LABEL = -(1 << 31)
BLOCK = "block long, held boolean, bins binary, label binary, times binary, margin binary"
_BLOCK = pa.schema([("block", pa.int64()), ("held", pa.bool_()), *[(n, pa.binary()) for n in ("bins", "label", "times", "margin")]])
SUMS = "output int, node int, sums binary"
_SUMS = pa.schema([("output", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])


@dataclass(frozen=True)
class BoostSettings:
    """``classes`` = 2 is one logistic tree a round, more are joint softmax.
    ``stop_on``: ``wrong`` rows or ``loss`` of the held-out rows."""
    classes: int = 2
    rounds: int = 100
    step_size: float = 0.05
    max_depth: int = 7
    max_leaves: int | None = None
    l2: float = 0.0
    subsample: float = 1.0
    level_columns: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    patience: int | None = None
    stop_on: str = "wrong"
    seed: int = 2020

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf. A row goes left when its
    bin is at most ``cut``, that is when its value is at most the cut's threshold."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        a = len(self.feature)
        for value in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(value)
            self.depth.append(self.depth[node] + 1)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        return a, a + 1

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def columns_by_depth(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {}
        for f, d in zip(self.feature, self.depth):
            if f >= 0:
                out.setdefault(d, set()).add(f)
        return out

    def nodes_of(self, n: int, goes_left) -> np.ndarray:
        """The leaf of each of ``n`` rows; ``goes_left(rows, feature, cut)`` compares."""
        node = np.zeros(n, np.int64)
        parts = [(0, np.arange(n))]
        while parts:        # rows of a node are dealt to its children together
            at, rows = parts.pop()
            if self.feature[at] < 0:
                node[rows] = at
            elif len(rows):
                left = goes_left(rows, self.feature[at], self.cut[at])
                parts += [(self.left[at], rows[left]), (self.right[at], rows[~left])]
        return node

    def splits(self) -> list[tuple[int, int]]:
        """The distinct (feature, cut) pairs."""
        return sorted({(f, c) for f, c in zip(self.feature, self.cut) if f >= 0})

    def outcomes(self) -> np.ndarray:
        """The leaf by the outcomes of all ``splits``: bit j says that split j goes right."""
        bit = {split: j for j, split in enumerate(self.splits())}
        return self.nodes_of(1 << len(bit), lambda codes, f, cut: codes >> bit[f, cut] & 1 == 0)


def thresholds(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Per feature the ascending values up to which its bins reach: all values
    of a feature that has few, quantiles (the least value first) of the others."""
    features = list(features)

    def few_values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.empty(0)] * len(features)
        for part in parts:
            for i, name in enumerate(features):
                if len(seen[i]) < BINS:
                    seen[i] = np.unique(np.concatenate([seen[i], np.unique(part[name].to_numpy(np.float64))]))[:BINS]
        yield pd.DataFrame([(i, float(x)) for i, own in enumerate(seen) for x in own], columns=["feature", "value"])

    values = df.select(*features).mapInPandas(few_values, "feature int, value double").distinct()
    per_feature = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    few = values.join(per_feature.where(F.col("n") < BINS).select("feature"), "feature")
    found: dict[str, list[float]] = {}
    for r in few.collect():      # below BINS values a feature
        found.setdefault(features[r["feature"]], []).append(r["value"])
    many = [f for f in features if f not in found]
    if many:
        probabilities = [i / (BINS - 1) for i in range(BINS - 1)]
        found.update({f: sorted(set(q)) for f, q in zip(many, df.approxQuantile(many, probabilities, QUANTILE_ERROR))})
    return [sorted(found.get(f, [])) for f in features]


class Packing:
    """Features by their number of bins, dealt to packs of at most ``PACK`` combinations. A pack's
    cell is the sum of stride x bin of its features, so a feature's bin is (cell // stride) % bins."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes, self.cells = list(sizes), []
        self.place = [(0, 1)] * len(self.sizes)         # (pack, stride) by feature
        for f in sorted(range(len(self.sizes)), key=lambda f: (-self.sizes[f], f)):
            room = [p for p, c in enumerate(self.cells) if c * self.sizes[f] <= PACK]
            if not room:
                room = [len(self.cells)]
                self.cells.append(1)
            p = max(room, key=lambda p: self.cells[p])
            self.place[f] = (p, self.cells[p] if self.sizes[f] > 1 else 1)
            self.cells[p] *= self.sizes[f]
        self.start = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)     # of a feature's bins side by side
        self.spread = np.concatenate([[], *[f * BINS + np.arange(n) for f, n in enumerate(self.sizes)]]).astype(int)

    def column(self, packs: np.ndarray, f: int) -> np.ndarray:
        p, stride = self.place[f]
        return packs[p] // np.uint8(stride) % np.uint8(self.sizes[f])

    def side_by_side(self, sums: np.ndarray, n_nodes: int) -> np.ndarray:
        """Histograms (weights, packs, nodes x PACK) as (weights, nodes, bins of all features)."""
        sums = sums.reshape(len(sums), len(self.cells), n_nodes, PACK)
        out = np.empty((len(sums), n_nodes, self.start[-1]))
        for f, (n, (p, stride)) in enumerate(zip(self.sizes, self.place)):
            own = sums[:, p, :, :self.cells[p]].reshape(len(sums), n_nodes, -1, n, stride)
            out[:, :, self.start[f]:self.start[f + 1]] = own.sum(axis=(2, 4))
        return out

    def cube(self, flat: np.ndarray) -> np.ndarray:
        """Bins of all features side by side, (weights, bins), as (weights, features, ``BINS``)."""
        out = np.zeros((len(flat), len(self.sizes) * BINS))
        out[:, self.spread] = flat
        return out.reshape(len(flat), -1, BINS)


@dataclass(frozen=True)
class Target:
    """What a boosting takes of stored blocks: of the rows whose label number ``positive`` is not
    0 (of all rows without it) those whose label number ``label`` is one of ``classes`` (ascending)."""
    label: int
    classes: tuple[int, ...]
    positive: int | None = None

    def place(self, labels: np.ndarray) -> np.ndarray:
        """The class of each row by its place in ``classes``, -1 for rows that take no part."""
        known, own = np.array(self.classes, np.int64), labels[self.label]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        ok = known[at] == own
        if self.positive is not None:
            ok &= (labels[self.positive] != 0) & (labels[self.positive] != NO_LABEL)
        return np.where(ok, at, -1)


def blocks_of(df: DataFrame, features: Sequence[str], cuts: list[list[float]], labels: Sequence[str], times: str | None,
              held: bool) -> DataFrame:
    """Binned blocks (see module doc) of complete rows, without margins, with all ``labels``."""
    features = list(features)
    edges, packing = [np.array(c) for c in cuts], Packing([len(c) + 1 for c in cuts])

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting
            while waiting and sum(len(w[2]) for w in waiting) >= least:
                whole = [np.concatenate([w[i] for w in waiting], axis=-1) for i in range(3)]
                own, waiting = [x[..., :BLOCK_ROWS] for x in whole], [tuple(x[..., BLOCK_ROWS:] for x in whole)]
                if not len(waiting[0][2]):
                    waiting = []
                number += 1
                yield pa.RecordBatch.from_pylist([{
                    "block": number * 2 + held, "held": held, "margin": b"",
                    **{name: x.tobytes() for name, x in zip(("bins", "label", "times"), own)}}], _BLOCK)

        for batch in batches:
            packs = np.zeros((len(packing.cells), batch.num_rows), np.uint8)
            for i, (p, stride) in enumerate(packing.place):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                packs[p] += np.searchsorted(edges[i], values, side="left").astype(np.uint8) * np.uint8(stride)
            label = np.stack([batch.column(len(features) + j).to_numpy() for j in range(len(labels))])
            waiting.append((packs, label, batch.column(len(features) + len(labels)).to_numpy()))
            yield from blocks(BLOCK_ROWS)
        yield from blocks(1)

    count = F.col(times) if times else F.lit(1)
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*features, *[F.coalesce(F.col(c).cast("int"), F.lit(NO_LABEL)).alias(f"__label{j}") for j, c in enumerate(labels)],
                     F.coalesce(count.cast("long"), F.lit(0)).alias("__times"))
    full = -(-df.count() // BLOCK_ROWS)      # no more partitions than full blocks
    # dealt evenly, a task for each core: every job reads them again
    return rows.coalesce(max(1, full)).mapInArrow(bin_rows, BLOCK).repartition(max(1, min(full, cores)))


@dataclass(frozen=True)
class Blocks:
    """Stored blocks of training and of held-out rows, apart: most jobs read the former only, and
    files of one size make tasks of one size."""
    train: DataFrame
    held_out: DataFrame

    def drop(self) -> None:
        drop_staged(self.train)
        drop_staged(self.held_out)


def stored_blocks(train: DataFrame, held_out: DataFrame, features: Sequence[str], cuts: list[list[float]], labels: Sequence[str],
                  times: str | None) -> Blocks:
    return Blocks(stage(blocks_of(train, features, cuts, labels, times, False), "boost-blocks"),
                  stage(blocks_of(held_out, features, cuts, labels, None, True), "boost-held-out"))


class _Block:
    """``target`` picks the rows of a block without margins."""

    def __init__(self, row: dict, packing: Packing, outputs: int, target: Target | None):
        self.id, self.held, self.packing = row["block"].as_py(), row["held"].as_py(), packing
        bins, label, times, margin = [row[n].as_buffer() for n in ("bins", "label", "times", "margin")]
        self.times = np.frombuffer(times, np.int64)
        n = len(self.times)
        self.bins = np.frombuffer(bins, np.uint8).reshape(-1, n)
        self.label = np.frombuffer(label, np.int32).reshape(-1, n)
        if target is None:
            self.label, self.margin = self.label[0], np.frombuffer(margin, np.float64).reshape(-1, outputs).copy()
        else:
            self.label = target.place(self.label)
            keep = np.flatnonzero(self.label >= 0)
            if len(keep) < n:
                self.bins, self.label, self.times = self.bins[:, keep], self.label[keep], self.times[keep]
            self.margin = np.zeros((len(keep), outputs))
        self._columns: dict[int, np.ndarray] = {}

    def column(self, f: int) -> np.ndarray:
        if f not in self._columns:
            self._columns[f] = self.packing.column(self.bins, f)
        return self._columns[f]

    def leaves(self, tree: Tree, table: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, with ``outcomes`` of the tree in ``table`` by comparing whole columns."""
        if table is not None:
            code = np.zeros(len(self.label), np.uint8)
            for j, (f, cut) in enumerate(tree.splits()):
                code |= (self.column(f) > cut).view(np.uint8) << np.uint8(j)
            return table[code]
        return tree.nodes_of(len(self.label), lambda rows, f, cut: self.column(f)[rows] <= cut)

    def add(self, rounds: list[list[Tree]], tables: list[list]) -> None:
        """Add the trees of ``rounds`` to the margins; ``tables`` are those of ``tables_of``."""
        for trees, known in zip(rounds, tables):
            for k, (tree, table) in enumerate(zip(trees, known)):
                self.margin[:, k] += np.array(tree.value)[self.leaves(tree, table)]

    def gradients(self, settings: BoostSettings) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the loss by output."""
        if settings.outputs == 1:
            p = 1 / (1 + np.exp(-self.margin))
            return p - self.label[:, None], p * (1 - p)
        p = softmax(self.margin)
        g = p.copy()
        g[np.arange(len(p)), self.label] -= 1
        return g, 2 * p * (1 - p)

    def wrong_and_loss(self, settings: BoostSettings) -> tuple[float, float]:
        if settings.outputs == 1:
            wrong = (self.margin[:, 0] > 0) != (self.label == 1)
            loss = np.logaddexp(0, np.where(self.label == 1, -1, 1) * self.margin[:, 0])
        else:
            wrong = self.margin.argmax(axis=1) != self.label
            top = self.margin.max(axis=1)
            loss = top + np.log(np.exp(self.margin - top[:, None]).sum(axis=1)) - self.margin[np.arange(len(top)), self.label]
        return float((wrong * self.times).sum()), float((loss * self.times).sum())


def tables_of(rounds: list[list[Tree]]) -> list[list]:
    return [[tree.outcomes() if len(tree.splits()) <= LOOKUP else None for tree in trees] for trees in rounds]


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def column_mask(settings: BoostSettings, n_features: int, round_no: int, output: int, level: int) -> np.ndarray:
    """The columns that splits of one level may use."""
    mask = np.ones(n_features, bool)
    if settings.level_columns < 1:
        rng = np.random.default_rng([settings.seed, round_no, output, level])
        keep = max(1, round(settings.level_columns * n_features))
        mask[rng.permutation(n_features)[keep:]] = False
    return mask


def counts_rows(settings: BoostSettings) -> bool:
    """Whether splits need row counts: a side with curvature has a row in any case."""
    return settings.min_rows > 1


def node_histograms(bins: np.ndarray, place: np.ndarray, n_nodes: int, weights: Sequence[np.ndarray],
                    cells: int = BINS) -> np.ndarray:
    """Sums of each weight by (feature, node and bin) of the rows with a place, as (weights, features, nodes x bins).
    ``bins`` holds a feature's bytes together: one feature's histogram stays in the cache while its rows are added.
    For packs there are ``PACK`` ``cells`` instead of bins."""
    out = np.empty((len(weights), len(bins), n_nodes * cells))
    start = place * cells
    for f, own in enumerate(bins):
        cell = own + start
        for j, w in enumerate(weights):
            out[j, f] = np.bincount(cell, w, n_nodes * cells)
    return out


def best_split(total: np.ndarray, settings: BoostSettings, mask: np.ndarray, least: float = 1e-12) -> tuple | None:
    """(gain, feature, cut, left G, H and, where rows are counted, n) of histograms
    (2 or 3, features, bins); ties go to the smaller feature, then the smaller cut. A side with a
    curvature below ``least`` is empty but for what sums have in their last bits."""
    left = np.cumsum(total, axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    lam = settings.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + lam) + right[0] ** 2 / (right[1] + lam) - whole[0] ** 2 / (whole[1] + lam)
    ok = np.minimum(left[1], right[1]) >= max(settings.min_hessian, least)
    if counts_rows(settings):
        ok &= np.minimum(left[2], right[2]) >= settings.min_rows
    gain = np.where(ok & mask[:, None] & np.isfinite(gain), gain, -np.inf)
    at = int(np.argmax(gain > gain.max() - 1e-9 * max(1.0, abs(float(gain.max())))))   # sums differ in their last bits
    f, cut = divmod(at, gain.shape[1])
    return (float(gain[f, cut]), f, cut, *left[:, f, cut].tolist()) if gain[f, cut] > MIN_GAIN else None


def rows_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in columns.items()}


class Booster:
    """One boosting; see module doc. ``rounds_`` holds the trees by round up to
    the best one, ``errors`` the held-out measure after each round built."""

    def __init__(self, settings: BoostSettings, features: Sequence[str], cuts: list[list[float]]):
        self.settings, self.features, self.cuts = settings, list(features), cuts
        self.packing = Packing([len(c) + 1 for c in cuts])
        self.rounds_: list[list[Tree]] = []
        self.errors: list[float] = []
        self.built = 0

    def fit(self, blocks: Blocks, target: Target) -> Booster:
        """``blocks`` stay as they are."""
        s, given, picks, held_rounds = self.settings, blocks, target, 0
        while True:
            pending = self.rounds_[held_rounds:]
            last = len(self.rounds_) == s.rounds
            if last and s.patience is None:
                break
            trees = [Tree() for _ in range(s.outputs)]
            kept: dict[tuple[int, int], np.ndarray] = {}        # histograms of the nodes that may be split
            heaps: list[list[tuple]] = [[] for _ in trees]
            frontier = [(k, 0) for k in range(s.outputs)]
            measured = bool(self.rounds_) and s.patience is not None
            found, measure = self._job(blocks, picks, pending, trees, [] if last else frontier, kept, measured)
            if measure is not None:
                self.errors.append(measure[0] if s.stop_on == "wrong" else measure[1])
                best = min(range(len(self.errors)), key=lambda i: (self.errors[i], i))
                if last or len(self.errors) - 1 - best >= s.patience:
                    self.rounds_ = self.rounds_[:best + 1]
                    break
            if last:     # without held-out rows
                break
            for (k, node), split in found.items():
                trees[k].value[node] = self._value(split["g"], split["h"])
            while frontier:
                frontier = self._grow(trees, heaps, frontier, found)
                if frontier:
                    found, _ = self._job(blocks, picks, pending, trees, frontier, kept, False)
            self.rounds_.append(trees)
            self.built += 1
            if len(self.rounds_) - held_rounds >= REBASE:
                moved = self._rebased(blocks, picks, self.rounds_[held_rounds:])
                if blocks is not given:
                    blocks.drop()
                blocks, picks, held_rounds = moved, None, len(self.rounds_)
        if s.patience is None:
            self.errors = self._held_out(given.held_out, target)
        if blocks is not given:
            blocks.drop()
        return self

    def _value(self, g: float, h: float) -> float:
        return -g / (h + self.settings.l2) * self.settings.step_size if h + self.settings.l2 > 0 else 0.0

    def _grow(self, trees, heaps, frontier, found) -> list[tuple[int, int]]:
        """Split what ``found`` allows; the new nodes that need histograms."""
        s, fresh = self.settings, []

        def split(k, node, x):
            children = trees[k].split(node, x["feature"], x["cut"], self._value(x["lg"], x["lh"]),
                                      self._value(x["g"] - x["lg"], x["h"] - x["lh"]))
            return [(k, c) for c in children if trees[k].depth[c] < s.max_depth]

        if s.max_leaves is None:
            for k, node in frontier:
                if (k, node) in found and found[k, node]["gain"] > MIN_GAIN:
                    fresh += split(k, node, found[k, node])
            return fresh
        for k, node in frontier:
            if (k, node) in found and found[k, node]["gain"] > MIN_GAIN:
                heaps[k].append((-found[k, node]["gain"], node, found[k, node]))
        for k, heap in enumerate(heaps):
            if heap and trees[k].leaves() < s.max_leaves:
                heap.sort(key=lambda x: x[:2])
                _, node, x = heap.pop(0)
                new = split(k, node, x)
                # a tree that is full needs no histograms; one without new nodes may still have leaves to split
                while not new and heap and trees[k].leaves() < s.max_leaves:
                    _, node, x = heap.pop(0)
                    new = split(k, node, x)
                if trees[k].leaves() < s.max_leaves:
                    fresh += new
        return fresh

    def _to_add_up(self, trees, frontier, kept) -> dict[tuple[int, int], tuple | None]:
        """The nodes of ``frontier`` whose histograms are added up, with the (parent, sibling) whose
        difference gives the sibling: of two siblings the one with less in it, by rows where they are counted."""
        out: dict[tuple[int, int], tuple | None] = {}
        for k, node in frontier:
            tree = trees[k]
            parent = next((i for i, f in enumerate(tree.feature) if f >= 0 and node in (tree.left[i], tree.right[i])), None)
            if parent is None:
                out[k, node] = None
            elif node == tree.left[parent]:
                at, cut = self.packing.start, tree.cut[parent]
                own = kept[k, parent][-1, at[tree.feature[parent]]:at[tree.feature[parent] + 1]]
                pair = (node, tree.right[parent]) if 2 * own[:cut + 1].sum() <= own.sum() else (tree.right[parent], node)
                out[k, pair[0]] = (parent, pair[1])
        return out

    def _job(self, blocks, target, pending, trees, frontier, kept, measured) -> tuple[dict, tuple | None]:
        """One pass: the best split of every frontier node, and the held-out measure. ``kept`` gets the
        histograms of the frontier and loses those of their parents."""
        s, packing, round_no = self.settings, self.packing, len(self.rounds_)
        added = self._to_add_up(trees, frontier, kept)
        wanted: dict[int, list[int]] = {}
        for k, node in added:
            wanted.setdefault(k, []).append(node)
        planes = 3 if counts_rows(s) else 2
        roots = all(node == 0 for _, node in added)

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            wrong = loss = 0.0
            tables, (own_tables,) = tables_of(pending), tables_of([trees])

            def add(key, bins, at, n_nodes, weights):
                own = node_histograms(bins, at, n_nodes, weights, PACK)
                if key in sums:
                    sums[key] += own
                else:
                    sums[key] = own

            for row in rows_of_batches(batches):
                block = _Block(row, packing, s.outputs, target)
                block.add(pending, tables)
                if block.held:
                    w, x = block.wrong_and_loss(s)
                    wrong, loss = wrong + w, loss + x
                    continue
                if not wanted:
                    continue
                times = block.times
                if s.subsample < 1:
                    times = np.random.default_rng([s.seed, round_no, block.id]).binomial(times, s.subsample)
                g, h = block.gradients(s)
                if roots:       # the same rows for all classes: they are looked up and counted once
                    rows = np.flatnonzero(times > 0)
                    m = times[rows].astype(np.float64)
                    bins = block.bins if len(rows) == len(times) else np.take(block.bins, rows, axis=1)
                    weights = [x[rows, k] * m for k in wanted for x in (g, h)]
                    add(-1, bins, np.zeros(len(rows), np.int64), 1, [*weights, m][:len(weights) + planes - 2])
                    continue
                for k, nodes in wanted.items():
                    place = np.full(len(trees[k].feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[block.leaves(trees[k], own_tables[k])]
                    rows = np.flatnonzero((at >= 0) & (times > 0))
                    m = times[rows].astype(np.float64)
                    add(k, np.take(block.bins, rows, axis=1), at[rows], len(nodes), (g[rows, k] * m, h[rows, k] * m, m)[:planes])
            out = []
            if -1 in sums:
                flat = packing.side_by_side(sums.pop(-1), 1)[:, 0]
                out += [(k, 0, np.concatenate([flat[2 * i:2 * i + 2], flat[2 * len(wanted):]]).tobytes()) for i, k in enumerate(wanted)]
            for k, own in sums.items():
                flat = packing.side_by_side(own, len(wanted[k]))
                out += [(k, node, flat[:, i].tobytes()) for i, node in enumerate(wanted[k])]
            if measured:
                out.append((-1, -1, struct.pack("<2d", wrong, loss)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SUMS)], schema=_SUMS)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, 0.0
            for row in rows_of_batches(batches):
                key = (row["output"].as_py(), row["node"].as_py())
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SUMS.names, (*at, total.tobytes())))], _SUMS)
                    at, total = key, 0.0
                total = total + np.frombuffer(row["sums"].as_buffer(), np.float64)
            if at is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(_SUMS.names, (*at, total.tobytes())))], _SUMS)

        read = blocks.train.unionByName(blocks.held_out) if measured else blocks.train
        sums, session = read.mapInArrow(histograms, SUMS), read.sparkSession
        if read.rdd.getNumPartitions() * len(added) * planes * packing.start[-1] * 8 > GATHER:
            # a node's sums are small: more tasks than cores only wait for each other
            tasks = min(len(added) + 1, session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
            sums = sums.repartition(tasks, "output", "node").sortWithinPartitions("output", "node").mapInArrow(add_up, SUMS)
        totals: dict[tuple[int, int], np.ndarray] = {}
        for r in sums.collect():     # histograms, see module doc
            key = (r["output"], r["node"])
            totals[key] = totals.get(key, 0.0) + np.frombuffer(r["sums"], np.float64)
        measure = tuple(totals.pop((-1, -1)).tolist()) if (-1, -1) in totals else None
        for (k, node), pair in added.items():
            if (k, node) in totals:
                kept[k, node] = totals[k, node].reshape(planes, -1)
                if pair is not None:
                    parent, sibling = pair
                    kept[k, sibling] = kept.pop((k, parent)) - kept[k, node]
        found = {}
        for k, node in frontier:
            if (k, node) in kept:
                cube = packing.cube(kept[k, node])
                g, h = cube[:2, 0].sum(axis=1).tolist()
                mask = column_mask(s, len(self.features), round_no, k, trees[k].depth[node])
                least = 1e-12 * max(1.0, h)
                gain, f, cut, lg, lh, *_ = best_split(cube, s, mask, least) or (0.0, -1, 0, 0.0, 0.0)
                found[k, node] = {"gain": gain, "feature": f, "cut": cut, "lg": lg, "lh": lh, "g": g, "h": h}
        return found, measure

    def _held_out(self, blocks: DataFrame, target: Target) -> list[float]:
        """The held-out measure after each round, in one job, for a boosting that does not wait for it."""
        s, packing, rounds = self.settings, self.packing, self.rounds_

        def measures(batches):
            sums, tables = np.zeros((len(rounds), 2)), tables_of(rounds)
            for row in rows_of_batches(batches):
                block = _Block(row, packing, s.outputs, target)
                for i in range(len(rounds)):
                    block.add(rounds[i:i + 1], tables[i:i + 1])
                    sums[i] += block.wrong_and_loss(s)
            yield pa.RecordBatch.from_pylist([{"output": -1, "node": -1, "sums": sums.tobytes()}], _SUMS)

        found = blocks.mapInArrow(measures, SUMS).collect()      # two numbers a round and task
        total = sum((np.frombuffer(r["sums"], np.float64) for r in found), np.zeros(2 * len(rounds))).reshape(-1, 2)
        return total[:, 0 if s.stop_on == "wrong" else 1].tolist()

    def _rebased(self, blocks: Blocks, target: Target | None, rounds: list[list[Tree]]) -> Blocks:
        """The rows of ``target`` as blocks of their own, with the trees of ``rounds`` added to their margins."""
        s, packing = self.settings, self.packing

        def moved(batches):
            tables = tables_of(rounds)
            for row in rows_of_batches(batches):
                block = _Block(row, packing, s.outputs, target)
                if not len(block.times):
                    continue
                block.add(rounds, tables)
                yield pa.RecordBatch.from_pylist([{
                    "block": block.id, "held": block.held, "bins": block.bins.tobytes(), "label": block.label.astype(np.int32).tobytes(),
                    "times": block.times.tobytes(), "margin": block.margin.tobytes()}], _BLOCK)

        held_out = blocks.held_out if s.patience is not None else blocks.held_out.limit(0)     # nobody waits for them
        return Blocks(stage(blocks.train.mapInArrow(moved, BLOCK), "boost-blocks"), stage(held_out.mapInArrow(moved, BLOCK), "boost-held-out"))

    def margins(self) -> Column:
        """Margins by output of rows that have the feature columns; only those that trees split by are read."""
        rounds, outputs = self.rounds_, self.settings.outputs
        used = sorted({f for trees in rounds for tree in trees for f in tree.feature if f >= 0}) or [0]
        at, cuts = {f: i for i, f in enumerate(used)}, [np.array(self.cuts[f] + [np.inf]) for f in used]

        @pandas_udf("array<double>")
        def score(values: pd.DataFrame) -> pd.Series:
            x = [values.iloc[:, i].to_numpy(np.float64) for i in range(len(used))]
            margin = np.zeros((len(values), outputs))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    leaf = tree.nodes_of(len(values), lambda rows, f, cut: x[at[f]][rows] <= cuts[at[f]][cut])
                    margin[:, k] += np.array(tree.value)[leaf]
            return pd.Series(list(margin))
        return score(F.struct(*[self.features[f] for f in used]))

    def predict(self) -> Column:
        """The class with the largest margin (ties: the smaller class)."""
        m = self.margins()
        if self.settings.outputs == 1:
            return (m[0] > 0).cast("int")
        return (F.array_position(m, F.array_max(m)) - 1).cast("int")


def fit_blocks(blocks: Blocks, features: Sequence[str], cuts: list[list[float]], settings: BoostSettings, target: Target) -> Booster:
    """Boosted trees of what ``target`` takes of stored blocks."""
    return Booster(settings, features, cuts).fit(blocks, target)


def fit_booster(train: DataFrame, held_out: DataFrame, features: Sequence[str], label: str, settings: BoostSettings,
                times: str | None = None, cuts: list[list[float]] | None = None) -> Booster:
    """Boosted trees of ``train`` (with multiplicities ``times``), stopped on
    ``held_out``. Labels are 0 .. classes - 1; rows are complete. Thresholds come
    from the training rows, each once, unless they are given."""
    cuts = thresholds(train, features) if cuts is None else cuts
    blocks = stored_blocks(train, held_out, features, cuts, [label], times)
    booster = fit_blocks(blocks, features, cuts, settings, Target(0, tuple(range(settings.classes))))
    blocks.drop()
    return booster
