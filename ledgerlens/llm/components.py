"""Connected components of an undirected edge list as Spark jobs.

Each task first contracts its own edges by union-find to one edge per node.
Then every node takes the smallest label among its neighbours and itself, and
follows it one step further, until nothing changes; rounds grow with the
logarithm of the longest path. Labels are written to the shared folder
after every round. Nothing is collected but the number of changes.

The label of a component is its smallest node. Nodes without an edge are not
listed; self-loops and repeated edges are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class UnionFind:
    """Forest over arbitrary integers; a root is the smallest of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        root = a
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(a, a)) != root:
            self.parent[a] = root
            a = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = list(self.parent)
        return np.array(nodes, np.int64), np.array([self.find(n) for n in nodes], np.int64)


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = UnionFind()
    for b in batches:
        for a, c in zip(b["a"].tolist(), b["b"].tolist()):
            forest.union(a, c)
    a, b = forest.pairs()
    yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long)."""
    own = edges.select("a", "b").where("a <> b").mapInPandas(contract, "a long, b long")
    both = stored(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), name)
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
                .withColumnRenamed("a", "at"))
        least = labels.join(near, F.col("node") == F.col("at")).select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("further"))
        jumped = stored(least.join(up, F.col("label") == F.col("up"), "left").select(
            "node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), name)
        changed = jumped.where("label <> before").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
