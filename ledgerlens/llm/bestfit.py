"""Best-fit-decreasing packing on counts.

Items of one size are interchangeable, and so are bins with one remaining
capacity. Packing therefore works on a histogram of sizes and gives *runs*:
"items number ``rank`` .. ``rank + count`` of size ``size`` go to bins ``bin`` ..,
each at ``offset``". The result is what packing item by item gives, but the
work and the driver's memory depend on the number of distinct sizes, not on
the number of items. Spark ranks the items of each size and looks the runs up.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np


@dataclass
class Runs:
    """Parallel arrays sorted by (size, rank): each run covers ``count`` ranks
    and puts rank + i into bin + i at the same offset (``step`` 1), or all
    into the same bin one behind the other (``step`` 0)."""
    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, int, int, int]]) -> "Runs":
        a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        return cls(*(np.ascontiguousarray(a[:, i]) for i in range(5)))

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of each item."""
        sizes, first = np.unique(self.size, return_index=True)
        wide = np.int64(max(int(self.rank.max(initial=0)), int(rank.max(initial=0))) + 1)
        at = np.searchsorted(sizes, size)
        keys = np.searchsorted(sizes, self.size) * wide + self.rank
        run = np.searchsorted(keys, at * wide + rank, side="right") - 1
        ahead = rank - self.rank[run]
        step = self.step[run]
        return self.bin[run] + ahead * step, self.offset[run] + np.where(step == 0, ahead * size, 0)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: ``tightest(s)`` is
    the smallest capacity of at least ``s`` that some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def push(self, remaining: int, first: int, n: int) -> None:
        if not self.open[remaining]:
            self._mark(remaining, 1)
        self.open[remaining].append((first, n))

    def pop(self, remaining: int) -> tuple[int, int]:
        got = self.open[remaining].pop()
        if not self.open[remaining]:
            self._mark(remaining, 0)
        return got

    def _mark(self, remaining: int, value: int) -> None:
        i = remaining + self.leaves
        self.some[i] = value
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        while not self.some[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.leaves


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[Runs, int]:
    """Best-fit decreasing of ``counts[size]`` items into bins of ``capacity``;
    returns the runs and the number of bins. Sizes must be 1..capacity."""
    tree, rows, bins = CapacityTree(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.tightest(size)
            if remaining is None:
                remaining, first = capacity, bins
                each = capacity // size
                n = max(1, left // each)
                bins += n
            else:
                first, n = tree.pop(remaining)
                each = remaining // size
            # after taking an item a bin is the tightest still, so it takes all it can
            full = min(n, left // each)
            if full:
                for j in range(each):
                    rows.append((size, rank, first, capacity - remaining + j * size, 1))
                    rank += full
                left -= full * each
                tree.push(remaining - each * size, first, full)
                if n > full:
                    tree.push(remaining, first + full, n - full)
            else:
                rows.append((size, rank, first, capacity - remaining, 0))
                tree.push(remaining - left * size, first, 1)
                if n > 1:
                    tree.push(remaining, first + 1, n - 1)
                left = 0
    return Runs.of(rows), bins


class Treap:
    """Balanced search tree of (remaining, bin) with ``ceiling`` lookups."""

    def __init__(self):
        self.root, self.seed = None, 1

    def _priority(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self.seed >> 20

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take_ceiling(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Remove and return the smallest entry of at least ``key``."""
        left, right = self._split(self.root, key)
        got = None
        if right is not None:
            node = right
            while node[1] is not None:
                node = node[1]
            got = node[0]
            _, right = self._split(right, (got[0], got[1] + 1))
        self.root = self._merge(left, right)
        return got

    def take_largest(self) -> tuple[int, int]:
        node = self.root
        while node[2] is not None:
            node = node[2]
        got = node[0]
        self.root, _ = self._split(self.root, got)
        return got


def pack_into(counts: list[tuple[int, int]], shards: int) -> Runs:
    """Best-fit decreasing of (size, number of groups) into exactly ``shards``
    bins whose fixed capacity is the equal share of all bytes. A group larger
    than the equal share of what is left has a shard to itself; a group that
    fits nowhere (at most a few at the end) goes to the emptiest shard.
    Offsets are not used."""
    rows, total = [], sum(s * c for s, c in counts)
    todo = [[s, c, 0] for s, c in sorted(counts, reverse=True)]
    free, i = shards, 0
    while free > 1 and i < len(todo) and todo[i][0] * free > total:
        size, left, rank = todo[i]
        rows.append((size, rank, shards - free, 0, 0))
        total, free = total - size, free - 1
        todo[i] = [size, left - 1, rank + 1]
        i += todo[i][1] == 0
    tree = Treap()
    for b in range(shards - free, shards):
        tree.add((-(-total // free), b))
    for size, left, rank in todo[i:]:
        while left:
            got = tree.take_ceiling((size, -1))
            if got is None:
                remaining, b = tree.take_largest()
                n = 1
            else:
                remaining, b = got
                n = min(left, remaining // size)
            rows.append((size, rank, b, 0, 0))
            tree.add((remaining - n * size, b))
            rank, left = rank + n, left - n
    return Runs.of(rows)


def pack_fixed(counts: list[tuple[int, int]], capacity: int) -> tuple[Runs, int]:
    """Best-fit decreasing into as few shards of ``capacity`` as it can; a
    group beyond the capacity has a shard to itself. Returns runs and shards."""
    rows, tree, bins = [], Treap(), 0
    for size, left in sorted(counts, reverse=True):
        rank = 0
        if size > capacity:
            rows.append((size, 0, bins, 0, 1))
            bins += left
            continue
        while left:
            got = tree.take_ceiling((size, -1))
            if got is None:
                got = (capacity, bins)
                bins += 1
            n = min(left, got[0] // size)
            rows.append((size, rank, got[1], 0, 0))
            tree.add((got[0] - n * size, got[1]))
            rank, left = rank + n, left - n
    return Runs.of(rows), bins
