"""Connected components of a large graph, and of a small one inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the smallest id reachable.

    Alternating star operations (Kiveris et al., 2014): neighbours larger than a node move to
    the smallest one around it, then smaller ones do, until nothing changes.  Each round is
    an aggregate and a join on the edges, checkpointed in the shared folder.
    """
    pairs = _cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = near.select("u", F.col("m").alias("v"))
        pairs = _cut(moved.unionByName(own))
        now = _state(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def _cut(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().checkpoint()


def _state(pairs: DataFrame) -> tuple:
    found = pairs.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("u", "v") % 1_000_003))
    ).first()
    return tuple(found)


class Union:
    """Roots of the nodes 0 to n - 1 under the links given so far."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is not a root, and its root."""
        roots = np.array([self.root(x) for x in range(len(self.up))], np.int64)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return at, roots[at]
