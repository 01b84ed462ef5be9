"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex (0 to n-1) that each vertex reaches by the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex but the roots themselves, from links (u, v) of longs; root is the smallest vertex reached.

    Alternates large and small stars until nothing moves: a number of rounds that grows with the logarithm of the
    longest path. The smallest neighbour is found by a partial aggregate and joined back, so a hot vertex is no
    group in one task. Each round is a written table. No links give no rows.
    """
    pairs = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialise(links.where("u <> v").select(pairs("u", "v").alias("p")).select("p.*").distinct())
    state = None
    while True:
        # large star: each larger neighbour of u goes to the smallest one of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: between plain exchanges Spark can split the rows of a hot vertex over tasks
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct())
        drop_table(low)
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        drop_table(now)
        drop_table(large)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state = seen
