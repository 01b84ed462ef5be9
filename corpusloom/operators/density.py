"""Clusters by density, with outliers: mutual reachability over a graph of neighbours, its minimum spanning forest, the condensed
tree of the clusters that grow together along the forest, and those clusters whose excess of mass is greatest.

The forest is followed from its lightest edge to its heaviest, in ranges of weight: the edges of a range join pieces that
don't touch, which are worked on apart, and each becomes one vertex of the next range.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import dropped, written
from .graph import TAIL, Sets, components, spanning_forest

#: Distances below this count as this, so that equal points have a density too.
LEAST = 1e-9


def mutual_reachability(graph: DataFrame, points: DataFrame, min_samples: int) -> DataFrame:
    """Edges (u, v, w): w is the greatest of the distance and both core distances.

    graph: (id, neighbours array<struct<d, id>>) as of `neighbours.neighbour_graph`; points: (id, copies). A core distance is that to the
    `min_samples`-th other point, copies counted; where the neighbours are fewer, that to the last one.
    """
    sizes = points.select("id", "copies")
    near = graph.select("id", F.explode("neighbours").alias("n")).select("id", "n.d", F.col("n.id").alias("other"))
    counted = near.join(sizes.select(F.col("id").alias("other"), F.col("copies").alias("more")), "other")
    reach = counted.withColumn("held", F.sum("more").over(Window.partitionBy("id").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, -1)))  # a window holds one point's neighbours
    cores = reach.join(sizes, "id").where(F.coalesce("held", F.lit(0)) + F.col("copies") - 1 < min_samples).groupBy("id").agg(F.max("d").alias("core"))
    cores = written(sizes.join(cores, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core")))
    core = lambda c: cores.select(F.col("id").alias(c), F.col("core").alias(f"{c}_core"))
    return near.select(F.col("id").alias("u"), F.col("other").alias("v"), "d").join(core("u"), "u").join(core("v"), "v").select("u", "v", F.greatest("d", "u_core", "v_core").alias("w"))


EVENT = "kind string, id long, node string, parent string, w double, size long, members array<long>"


def _grow(vertices: pd.DataFrame, edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """Follows the edges of one piece in order. Rows: `point` members fall out of node at w; `child` node, of that size, is born of
    parent at w; `vertex` id, what is left; `moved` id into size (the number of the vertex that it is part of)."""
    size, node, members, sets, out = {}, {}, {}, Sets(), []
    for r in vertices.itertuples(index=False):
        size[r.id], node[r.id], members[r.id] = r.size_, r.node, list(r.members) if r.members is not None else []
    add = lambda kind, id_=0, name=None, parent=None, w=0.0, n=0, who=None: out.append((kind, id_, name, parent, w, n, who))
    for e in edges.sort_values(["w", "u", "v"], kind="stable").itertuples(index=False):
        a, b = sets.find(e.a), sets.find(e.b)
        low = sets.join(a, b)
        total = size[a] + size[b]
        if node[a] and node[b]:
            new = f"{e.u}:{e.v}"
            for x in (a, b):
                add("child", name=node[x], parent=new, w=e.w, n=size[x])
            mine, left = new, []
        elif node[a] or node[b]:
            mine, left = node[a] or node[b], []
            add("point", name=mine, w=e.w, who=members[b] if node[a] else members[a])
        elif total >= min_size:
            mine, left = f"{e.u}:{e.v}", []
            add("point", name=mine, w=e.w, who=members[a] + members[b])
        else:
            mine, left = None, members[a] + members[b]
        size[low], node[low], members[low] = total, mine, left
    for k in size:
        root = sets.find(k)
        if root == k:
            add("vertex", k, node[k], n=size[k], who=members[k])
        else:
            add("moved", k, n=root)
    return pd.DataFrame(out, columns=["kind", "id", "node", "parent", "w", "size", "members"])


def condensed_tree(forest: DataFrame, points: DataFrame, min_size: int, tail: int = TAIL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of clusters of at least `min_size` points along a spanning forest (u, v, w) of points (id, copies).

    Returns falls (id, node, w): the distance at which each point leaves its cluster as distances shrink; births (node, parent,
    w, size) of clusters that split off another; and tops (node), which no other holds. Points of pieces too small
    for a cluster are in none of them.
    """
    alone = F.when(F.col("copies") >= min_size, F.concat(F.lit("="), F.col("id")))  # as many equal points are a cluster
    vertices = written(points.select("id", F.col("copies").alias("size_"), alone.alias("node"), F.when(alone.isNull(), F.array("id")).alias("members")))
    falls, births = [points.select("id", alone.alias("node"), F.lit(0.0).alias("w")).where("node is not null")], []
    left = written(forest.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"))
    while n := left.count():
        share = 0.5
        while n > tail:
            at = left.agg(F.percentile_approx("w", share, 10_000)).first()[0]
            first = F.col("w") < at
            if not left.where(first).limit(1).count():  # many edges of one weight: part of them, in the order of u
                at = left.agg(F.min("w")).first()[0]
                u = left.where(F.col("w") == at).agg(F.percentile_approx("u", share, 10_000)).first()[0]
                first = (F.col("w") == at) & (F.col("u") <= u)
            batch = left.where(first)
            named = components(batch.select(F.col("a").alias("u"), F.col("b").alias("v")), tail)
            named = written(named)
            batch = written(batch.join(named.select(F.col("v").alias("a"), F.col("root").alias("piece")), "a"))
            if batch.groupBy("piece").count().agg(F.max("count")).first()[0] <= tail or share < 1e-3:
                break
            share /= 2
        else:
            first, batch = F.lit(True), left.withColumn("piece", F.lit(0).cast("long"))
            named = batch.select("a", "b").select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.lit(0).cast("long"))
        touched = vertices.join(named.select(F.col("v").alias("id"), F.col("root").alias("piece")), "id")

        def grow(key, some: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            return _grow(some, edges, min_size)

        done = written(touched.groupBy("piece").cogroup(batch.groupBy("piece")).applyInPandas(grow, EVENT))
        falls.append(done.where("kind = 'point'").select(F.explode("members").alias("id"), "node", "w"))
        births.append(done.where("kind = 'child'").select("node", "parent", "w", "size"))
        fresh = done.where("kind = 'vertex'").select("id", F.col("size").alias("size_"), "node", F.when(F.col("node").isNull(), F.col("members")).alias("members"))
        gone = done.where("kind in ('vertex', 'moved')").select("id")
        after = written(vertices.join(gone, "id", "left_anti").unionByName(fresh))
        dropped(vertices)
        vertices = after
        moved = lambda c: done.where("kind = 'moved'").select(F.col("id").alias(c), F.col("size").alias(f"{c}_"))  # noqa: B023, E731
        rest = left.where(~first).join(moved("a"), "a", "left").join(moved("b"), "b", "left")
        after = written(rest.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"), "u", "v", "w"))
        dropped(left)
        left = after
    none = points.sparkSession.range(0).selectExpr("string(null) as node", "string(null) as parent", "double(null) as w", "id as size")
    return reduce(DataFrame.union, falls), reduce(DataFrame.union, births, none), vertices.where("node is not null").select("node")


def _select(tree: pd.DataFrame) -> pd.DataFrame:
    """The clusters of greatest excess of mass, from (node, parent, birth, mass, count, size); a node's own mass counts from its birth."""
    rows = {r.node: r for r in tree.itertuples(index=False)}
    children: dict[str, list[str]] = {}
    for r in rows.values():
        if r.parent is not None:
            children.setdefault(r.parent, []).append(r.node)
    tops = [r.node for r in rows.values() if r.parent is None]
    order, stack = [], list(tops)
    while stack:
        order.append(stack.pop())
        stack += children.get(order[-1], [])
    best, chosen = {}, set()
    for name in reversed(order):
        r, below = rows[name], math.fsum(best[c] for c in children.get(name, []))
        own = r.mass - r.count * r.birth
        if children.get(name) and below > own or len(tops) == 1 and r.parent is None:
            best[name] = below
        else:
            best[name] = own
            chosen.add(name)
    label: dict[str, str | None] = {}
    for name in order:
        above = label.get(rows[name].parent) if rows[name].parent is not None else None
        label[name] = above or (name if name in chosen else None)
    return pd.DataFrame({"node": order, "cluster": [label[n] for n in order]}, columns=["node", "cluster"])


def density_clusters(graph: DataFrame, points: DataFrame, min_size: int = 10, min_samples: int | None = None, tail: int = TAIL) -> DataFrame:
    """(id, cluster int, probability double) of each of points (id, copies): -1 and null for outliers.

    Clusters are those of the graph's edges: points that no path of neighbours joins are infinitely far apart. A cluster that
    holds all the others is none. They are numbered by size, copies counted, ties by smallest id. The probability is
    the density at which a point leaves its cluster, in parts of that at which the last one does.
    """
    points = points.select("id", "copies")
    edges = mutual_reachability(graph, points, min_samples or min_size)
    forest = written(spanning_forest(edges, tail))
    falls, births, tops = condensed_tree(forest, points, min_size, tail)
    density = lambda c: 1 / F.greatest(F.col(c), F.lit(LEAST))
    falls = written(falls.join(points, "id").select("id", "node", density("w").alias("at"), "copies"))
    births = written(births.select("node", "parent", density("w").alias("at"), "size"))
    each = falls.select("node", "at", F.col("copies").alias("n")).unionByName(births.select(F.col("parent").alias("node"), "at", F.col("size").alias("n")))
    sums = each.groupBy("node").agg(F.sum(F.col("at") * F.col("n")).alias("mass"), F.sum("n").alias("count"), F.max("at").alias("last"))
    nodes = tops.withColumn("parent", F.lit(None).cast("string")).withColumn("birth", F.lit(0.0)).unionByName(births.select("node", "parent", F.col("at").alias("birth")))
    nodes = written(nodes.join(sums, "node"))
    # one row a cluster of at least min_size points, none of the points themselves
    labels = nodes.select("node", "parent", "birth", "mass", "count").groupBy().applyInPandas(_select, "node string, cluster string").where("cluster is not null")
    labels = written(labels.join(nodes.select(F.col("node").alias("cluster"), "last"), "cluster"))
    inside = written(falls.join(labels, "node").select("id", "copies", "cluster", F.least(F.col("at") / F.col("last"), F.lit(1.0)).alias("probability")))
    sizes = inside.groupBy("cluster").agg(F.sum("copies").alias("n"), F.min("id").alias("least"))
    numbers = sizes.select("cluster", (F.row_number().over(Window.orderBy(F.col("n").desc(), "least")) - 1).alias("number"))  # one row a cluster
    out = inside.join(numbers, "cluster").select("id", F.col("number").cast("int").alias("cluster"), "probability")
    return points.select("id").join(out, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "probability")
