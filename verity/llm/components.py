"""Connected components of links by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on plain columns, so nothing about a component is gathered in one task
but its smallest id; skewed joins are split by adaptive execution. A round is checkpointed, and rounds stop when
the links no longer change (the stars are then the components). The number of rounds grows as the logarithm of a
component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(u long, v long) -> (id, component): each linked id with the smallest id that it reaches."""
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    sign = _sign(links)
    for _ in range(rounds):
        # Large star: each neighbour above u is hung on the smallest of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are hung on the smallest of them.
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        hung = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if (now := _sign(links)) == sign:
            return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        sign = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _sign(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.shiftright(h, 7).cast("decimal(38,0)"))).first())


class Forest:
    """Union-find over 0..n-1 in numpy: many unions at a time; keeps a spanning forest of what it is given."""

    def __init__(self, n: int):
        import numpy as np

        self.parent = np.arange(n)

    def union(self, a, b) -> None:
        import numpy as np

        parent = self.parent
        while len(a):
            while True:  # roots of both ends
                pa, pb = parent[a], parent[b]
                if (pa == a).all() and (pb == b).all():
                    break
                a, b = pa, pb
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = parent

    def roots(self):
        import numpy as np

        parent = self.parent
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        self.parent = parent
        return parent
