"""Distributed connected components by alternating large and small stars.

Edges are kept as (u, v) with u > v.  A large star hangs every neighbour of v
that is greater than v on the least node around v; a small star hangs the lesser
neighbours of u, and u, on the least of them.  Repeated until nothing changes,
each component is one star on its least node.  A node's neighbours are never
gathered: least nodes come from map-side-combined aggregates and return by a
join, whose sides are both dealt by a hash of the key made for it, so that the
adaptive engine can split a node that holds many edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import Scratch


def hang(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """Joins (node, m) to the edges on ``key``; a fresh exchange on both sides."""
    left = edges.withColumn("_h", F.xxhash64(key))
    right = least.select(F.col("node").alias("_node"), "m", F.xxhash64("node").alias("_g"))
    return left.join(right, (F.col("_h") == F.col("_g")) & (F.col(key) == F.col("_node")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of (a, b) that isn't its component's least node; root is that least node.

    Edges may repeat and run in either direction; a loop links nothing; no edges
    give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e, "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.select(F.col("u").alias("node"), F.col("v").alias("x")).union(e.select(F.col("v").alias("node"), F.col("u").alias("x")))
        least = both.groupBy("node").agg(F.min("x").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = scratch.save(hang(e, least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        scratch.drop(e)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        hung = hang(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(hung.union(least.select("node", "m")).distinct(), "small")
        scratch.drop(large)


class Forest:
    """Spanning stars of what has been linked within one tile of n rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        pairs = np.unique(np.minimum(a, b) * len(self.root) + np.maximum(a, b))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for p in pairs.tolist():
            x, y = find(p // len(self.root)), find(p % len(self.root))
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.root))
        for x in up:
            to[x] = find(x)
        self.root = to[self.root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each linked row that isn't its star's centre, and that centre."""
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return i, self.root[i]
