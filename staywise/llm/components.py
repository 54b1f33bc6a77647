"""Connected components of a graph given by its edges, as repeated joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import materialize


class Forest:
    """Union-find over 0..n-1 inside one task, merging whole arrays of pairs at once."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def _flatten(self) -> None:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return
            self.parent = above

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self._flatten()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One (member, root) pair for each element that is no root: at most n - 1 edges say who belongs together."""
        member = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return member, self.parent[member]


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node it can reach.

    Alternates two steps until nothing changes: every node hands its larger neighbours its smallest neighbour
    (large star), then all its smaller neighbours and itself (small star). Each is a grouped minimum, combined
    before the shuffle, and a join that adaptive execution splits where a node has very many neighbours; no list of
    neighbours is ever gathered. Edges are checkpointed after each round. Nulls, loops and repeated edges are ignored.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
