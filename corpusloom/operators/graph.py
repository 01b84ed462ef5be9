"""Weighted graphs as tables: connected components and the minimum spanning forest.

Each round is a written table in the shared folder. What is left of a graph once it has no more than `tail` edges is
finished in one task; the result is the same with any tail.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import dropped, written

#: Edges that one task may hold: 24 MB.
TAIL = 1 << 20


class Sets:
    """Disjoint sets of numbers; a set goes by its smallest one."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root:
            self.up[x], x = root, above
        return root

    def join(self, a: int, b: int) -> int:
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        return low


def components(links: DataFrame, tail: int = TAIL) -> DataFrame:
    """(v, root) of every vertex of links (u, v) of longs; root is the smallest vertex it reaches.

    Alternates stars: larger neighbours of a vertex go to its smallest one, then so do the vertex and its smaller ones.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    vertices, state = written(links.select("u").union(links.select("v")).distinct().withColumnRenamed("u", "v")), None
    while True:
        n = now.count()
        if n <= tail:

            def finish(frame: pd.DataFrame) -> pd.DataFrame:
                sets = Sets()
                for a, b in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                    a, b = sets.find(a), sets.find(b)
                    if a != b:
                        sets.join(a, b)
                every = sorted(set(frame["u"]) | set(frame["v"]))
                return pd.DataFrame({"u": every, "v": [sets.find(x) for x in every]})

            now = now.groupBy().applyInPandas(finish, "u long, v long").where("u <> v")
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = written(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(low, large, now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return vertices.join(now.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def _kruskal(frame: pd.DataFrame) -> pd.DataFrame:
    sets, kept = Sets(), []
    order = frame.sort_values(["w", "u", "v"], kind="stable")
    for row in order.itertuples(index=False):
        a, b = sets.find(row.a), sets.find(row.b)
        if a != b:
            sets.join(a, b)
            kept.append((row.u, row.v, row.w))
    return pd.DataFrame(kept, columns=["u", "v", "w"]).astype({"u": "int64", "v": "int64", "w": "float64"})


def spanning_forest(edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """The minimum spanning forest (u, v, w), u < v, of edges (u long, v long, w double), in the order of w, u, v, so there is only one.

    Borůvka rounds: every component takes its lightest edge out, and components that edges join get one name by following
    them to their end. Between two components only the lightest edge is kept. Parallel edges count once; loops and null
    weights are left out.
    """
    edge = F.struct("w", "u", "v")
    live = edges.where("u <> v and w is not null").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    live = written(live.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"))
    parts = []
    while (n := live.count()) > tail:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "w"))
        best = written(both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("e")).select(F.col("a").alias("c"), "e.*"))
        parts.append(written(best.select("u", "v", "w").distinct()))
        other = best.select(F.col("c").alias("b"), F.col("u").alias("ou"), F.col("v").alias("ov"))
        # two components that took the same edge: the smaller one is the end of all that lead there
        up = best.join(other, "b").select("c", F.when((F.col("u") == F.col("ou")) & (F.col("v") == F.col("ov")) & (F.col("c") < F.col("b")), F.col("c")).otherwise(F.col("b")).alias("p"))
        up = written(up)
        while True:
            above = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            after = written(up.join(above, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            moved = after.where("moved").limit(1).count()
            dropped(up)
            up = after.drop("moved")
            if not moved:
                break
        name = lambda c: up.select(F.col("c").alias(c), F.col("p").alias(f"{c}_"))  # noqa: B023, E731
        named = live.join(name("a"), "a").join(name("b"), "b").where("a_ <> b_")
        after = written(named.groupBy(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).agg(F.min(edge).alias("e")).select("a", "b", "e.u", "e.v", "e.w"))
        dropped(live, best, up)
        live = after
    if n:
        parts.append(live.groupBy().applyInPandas(_kruskal, "u long, v long, w double"))
    out = parts[0] if parts else live.select("u", "v", "w")
    for part in parts[1:]:
        out = out.union(part)
    return out
