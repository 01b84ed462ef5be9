"""The graph of nearest neighbours of vectors, and a layout of it in few dimensions.

Points are dealt several times to blocks of a bounded size, in orders that random hyperplanes give, so that near points often
share a block; a block finds its nearest neighbours exactly. Then neighbours of one point are introduced to each other,
which mends what the blocks missed. No two points meet otherwise, so the work grows with the points. Where none may be missed,
`exact_neighbours` lets all blocks meet within the bounds that this gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import dropped, written

FOUND = "id long, neighbours array<struct<d: double, id: long>>"
#: Points of other places that push a point away in a layout: a random sample of this size goes to every task.
STRANGERS = 4096


def distinct_points(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points (id, copies, vector) of equal vectors, and (key, id) of the rows they stand for; id is the smallest key.

    Vectors that are null or have null or non-finite components are left out. With `cosine` they are cut to length 1 first (zero
    vectors stay), so that Euclidean neighbours are those of the smallest angle.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("key").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if cosine:
        rows = rows.withColumn("n", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).withColumn("vector", F.when(F.col("n") > 0, F.transform("vector", lambda x: x / F.col("n"))).otherwise(F.col("vector"))).drop("n")
    rows = written(rows)  # else the join would check and cut each vector anew, once for each of its components
    points = written(rows.groupBy("vector").agg(F.min("key").alias("id"), F.count("*").alias("copies")).select("id", "copies", "vector"))
    keys = written(rows.join(points.select("vector", "id"), "vector").select("key", "id"))
    dropped(rows)
    return points, keys


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(square: np.ndarray) -> type:
    """Single precision, wherever squared lengths fit."""
    return np.float32 if square.max() < 1e30 else np.float64


def _margin(dims: int, kind: type) -> float:
    """By how much of both squared lengths a squared distance from products can be wrong, at most, and as much again."""
    return 4 * (dims + 8) * float(np.finfo(kind).eps)


def _gaps(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) of rows, each that of the pair alone."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        gap = x[i[lo : lo + (1 << 16)]] - x[j[lo : lo + (1 << 16)]]
        out[lo : lo + (1 << 16)] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def nearest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest other rows of each row, ties to the smaller id. Distances are those of the pair alone,
    whatever else is in the block."""
    n = len(x)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int64), np.zeros((n, 0))
    if (most := np.abs(x).max()) > 1e150:  # a power of two keeps ties
        most = 2.0 ** np.floor(np.log2(most))
        where, d = nearest(x / most, ids, k)
        return where, d * most
    square = np.einsum("ij,ij->i", x, x)
    for kind in dict.fromkeys((_kind(square), np.float64)):
        y = x.astype(kind)
        rough = y @ y.T
        rough *= -2
        rough += square.astype(kind)
        np.fill_diagonal(rough, np.inf)
        # all that products can't tell from the k nearest are measured
        far = np.partition(rough, k - 1, axis=1)[:, k - 1] + _margin(x.shape[1], kind) * (square + square.max())
        i, j = np.divmod(np.flatnonzero(rough <= far.astype(kind)[:, None]), n)
        if len(i) <= 4 * k * n:
            break
    d = _gaps(x, i, j)
    order = np.lexsort((ids[j], d, i))
    order = order[np.searchsorted(i, np.arange(n))[:, None] + np.arange(k)]
    return j[order], d[order]


def _found(ids: np.ndarray, neighbours: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    n, k = neighbours.shape
    return _lists(ids, np.arange(n + 1) * k, neighbours.ravel(), distances.ravel())


def _lists(ids: np.ndarray, offsets: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    pairs = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(other, pa.int64())], ["d", "id"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["id", "neighbours"])


def _nearest_of(owner: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (owner, other, distance) the k nearest of each owner, ties to the smaller id, in the order of owners. Equal rows count once."""
    order = np.lexsort((other, d, owner))
    owner, other, d = owner[order], other[order], d[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1]) | (d[1:] != d[:-1])
    owner, other, d = owner[new], other[new], d[new]
    starts = _starts(owner)
    keep = np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner))) < k
    return owner[keep], other[keep], d[keep]


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]]))


def _by_owner(owner: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> pa.RecordBatch:
    """The rows of `_nearest_of` as lists, one an owner."""
    owner, other, d = _nearest_of(owner, other, d, k)
    starts = _starts(owner)
    return _lists(owner[starts], np.append(starts, len(owner)), other, d)


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of some `rows` rows of batches in the order of id; no id is in two of them."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            ids = table.column("id").to_numpy()
            if cut := int(np.searchsorted(ids, ids[-1])):
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count -= cut
    if count:
        yield pa.Table.from_batches(held)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all that was found of each point: a bounded number of lists of k."""

    def pick(batches: Iterator[pa.RecordBatch]):
        for rows in _whole(batches, 10_000):
            rows = rows.combine_chunks()
            sizes = pc.list_value_length(rows.column("d")).to_numpy()
            owner = np.repeat(rows.column("id").to_numpy(), sizes)
            yield _by_owner(owner, pc.list_flatten(rows.column("other")).to_numpy(), pc.list_flatten(rows.column("d")).to_numpy(), k)

    lists = found.select("id", F.col("neighbours.d").alias("d"), F.col("neighbours.id").alias("other"))
    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(pick, FOUND)


def _blocks(points: DataFrame, count: int, k: int, orders: int, block: int, seed: int) -> DataFrame:
    dims = points.select(F.size("vector")).first()[0]
    bits = min(62, max(1, math.ceil(math.log2(max(2, count / block))) + 3))
    planes = np.random.default_rng(seed).normal(size=(orders, bits, dims))

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for t in range(orders):
                side = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(side), batch.column("id"), batch.column("vector")], ["turn", "side", "id", "vector"])

    parts = max(1, -(-count * orders // (8 * block)))
    dealt = points.select("id", "vector").mapInArrow(deal, "turn int, side long, id long, vector array<double>")
    dealt = dealt.repartitionByRange(parts, "turn", "side", "id").sortWithinPartitions("turn", "side", "id")

    def search(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []

        def full(last: bool):
            rows = pa.Table.from_batches(held)
            turn = rows.column("turn").to_numpy()
            at = 0
            while at < len(turn):
                end = int(min(np.searchsorted(turn, turn[at], "right"), at + block))
                if not last and end == len(turn) and end - at < block:
                    break
                if last or end - at == block or end < len(turn):
                    part = rows.slice(at, end - at)
                    ids = part.column("id").to_numpy()
                    where, d = nearest(_matrix(part.column("vector")), ids, k)
                    yield _found(ids, ids[where], d)
                at = end
            held[:] = rows.slice(at).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block:
                yield from full(False)
        if held:
            yield from full(True)

    return dealt.mapInArrow(search, FOUND)


def _introduced(points: DataFrame, graph: DataFrame, k: int, seed: int) -> DataFrame:
    """What neighbours of one point, from it or to it, find among each other that is nearer than what they have."""
    near = graph.select("id", F.explode("neighbours").alias("n")).select("id", F.col("n.id").alias("other"))
    # as many of those that have the point for a neighbour, at random: the limit cuts the rows of a hub before they move
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("id", "other", F.lit(seed)), "id"))
    back = near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("other").alias("id"), F.col("id").alias("other"))
    pairs = near.union(back).union(graph.select("id", F.col("id").alias("other"))).distinct()
    worst = graph.select(F.col("id").alias("other"), F.element_at("neighbours", -1)["d"].alias("worst"))
    known = points.select(F.col("id").alias("other"), "vector").join(worst, "other")
    rows = pairs.join(known, "other").select("id", "other", "vector", "worst").repartition("id").sortWithinPartitions("id", "other")

    def introduce(batches: Iterator[pa.RecordBatch]):
        for rows in _whole(batches, 20_000):
            x, ids, worst = _matrix(rows.column("vector")), rows.column("other").to_numpy(), rows.column("worst").to_numpy()
            i, j = _nearer_pairs(x, rows.column("id").to_numpy(), worst)
            d = _gaps(x, i, j)
            some = d < worst[i]
            yield _by_owner(ids[i[some]], ids[j[some]], d[some], k)

    return rows.mapInArrow(introduce, FOUND)


def _nearer_pairs(x: np.ndarray, owner: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of one owner that hold every pair nearer than i's worst, and few others. Owners of as many rows are worked on together."""
    square = np.einsum("ij,ij->i", x, x)
    kind = _kind(square)
    y, size = x.astype(kind), square.astype(kind)
    far = (worst**2 * (1 + 1e-9) + _margin(x.shape[1], kind) * (square + square.max()) - square).astype(kind)
    starts = _starts(owner)
    sizes = np.diff(starts, append=len(owner))
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(sizes):
        groups = starts[sizes == s][:, None] + np.arange(s)
        step = max(1, (1 << 19) // (s * s))
        for lo in range(0, len(groups), step):
            at = groups[lo : lo + step]
            rough = y[at] @ y[at].transpose(0, 2, 1)
            rough *= -2
            rough += size[at][:, None, :]
            g, i, j = np.nonzero(rough <= far[at][:, :, None])
            one.append(at[g, i])
            two.append(at[g, j])
    i, j = np.concatenate(one), np.concatenate(two)
    return i[i != j], j[i != j]


def neighbour_graph(points: DataFrame, k: int = 15, orders: int = 8, block: int = 1024, rounds: int = 2, seed: int = 7) -> DataFrame:
    """(id, neighbours array<struct<d, id>>): up to k nearest other points of each of (id, vector), nearest first, ties by id.

    Exact where all points fit one block, else nearly so: more `orders`, larger blocks and more `rounds` find more. A point
    alone has no neighbours and no row.
    """
    count = points.count()
    if not count:
        return points.sparkSession.createDataFrame([], FOUND)
    if count <= block:
        orders, rounds = 1, 0
    graph = written(_best(_blocks(points, count, k, orders, block, seed), k).where(F.size("neighbours") > 0))
    for r in range(rounds):
        after = written(_best(graph.union(_introduced(points, graph, k, seed + r)), k))
        dropped(graph)
        graph = after
    return graph


def _pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of the same place, squares added in the order of components."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += (x[:, c] - y[:, c]) ** 2
    return np.sqrt(total)


def _close_pairs(x: np.ndarray, y: np.ndarray, far_x: np.ndarray, far_y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (row of x, row of y) that hold every pair no further apart than the bound of either, and few others.

    Products decide in single precision, wherever numbers fit; a margin above what they can be wrong by loses no pair.
    With `same` both are one block, and each pair comes once.
    """
    size_x, size_y = (x**2).sum(1), (y**2).sum(1)
    kind = _kind(np.append(size_x.max(), size_y.max()))
    margin = _margin(x.shape[1], kind)
    # one product gives -d^2 / 2
    a = np.concatenate([x, size_x[:, None] / -2, np.ones((len(x), 1))], 1).astype(kind)
    b = np.concatenate([y, np.ones((len(y), 1)), size_y[:, None] / -2], 1).astype(kind)
    least_x = ((far_x**2 + margin * (size_x + size_y.max())) / -2).astype(kind)
    least_y = ((far_y**2 + margin * (size_y + size_x.max())) / -2).astype(kind)
    for r in range(0, len(x), 512):
        for c in range(r if same else 0, len(y), 2048):
            g = a[r : r + 512] @ b[c : c + 2048].T
            i, j = np.divmod(np.flatnonzero((g >= least_x[r : r + 512, None]) | (g >= least_y[c : c + 2048])), g.shape[1])
            i, j = i + r, j + c
            once = i < j if same else slice(None)
            i, j = i[once], j[once]
            for lo in range(0, len(i), 1 << 16):
                yield i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]


def exact_neighbours(points: DataFrame, k: int = 15, block: int = 1 << 15, seed: int = 7) -> DataFrame:
    """(id, neighbours array<struct<d, id>>): the k nearest other points of each of (id, vector), nearest first, ties by id; none is missed.

    `neighbour_graph` gives each point a bound that its k nearest don't exceed. Then every two blocks of points meet in one task,
    which measures the pairs within a bound. That is quadratic in points; a task holds two blocks, a point moves once a block.
    """
    count = points.count()
    if count < 2:
        return points.sparkSession.createDataFrame([], FOUND)
    bounds = neighbour_graph(points, k, orders=4, rounds=2, seed=seed)
    far = F.when(F.size("neighbours") >= k, F.element_at("neighbours", -1)["d"] * (1 + 1e-9)).otherwise(float("inf"))
    blocks = max(1, -(-count // block), min(8, count // 512))
    rows = points.select("id", "vector").join(bounds.select("id", far.alias("far")), "id", "left").select("id", "vector", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "met").alias("one"), F.greatest("own", "met").alias("two"), "own", "id", "vector", "far")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        one, two = (v.as_py() for v in key)
        own, ids, far, x = table.column("own").to_numpy(), table.column("id").to_numpy(), table.column("far").to_numpy(), _matrix(table.column("vector"))
        first, second = np.flatnonzero(own == one), np.flatnonzero(own == two)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        new, held = [kept], 0
        if len(first) and len(second):
            for i, j in _close_pairs(x[first], x[second], far[first], far[second], one == two):
                i, j = first[i], second[j]
                d = _pair_distances(x[i], x[j])
                for u, v in ((i, j), (j, i)):
                    some = d <= far[u]
                    new.append((ids[u[some]], ids[v[some]], d[some]))
                    held += int(some.sum())
                if held > 1 << 21:
                    new, held = [_nearest_of(*map(np.concatenate, zip(*new, strict=True)), k)], 0
        return pa.Table.from_batches([_by_owner(*map(np.concatenate, zip(*new, strict=True)), k)])

    tiles = blocks * (blocks + 1) // 2
    return _best(rows.repartition(2 * tiles, "one", "two").groupBy("one", "two").applyInArrow(meet, FOUND), k)


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """(u, v, weight), u < v: how surely two points are neighbours, 1 for the nearest, with each point's own scale; a or b, as of fuzzy sets.

    A point's scale makes the weights of its k neighbours add up to log2(k).
    """

    def scale(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column("neighbours")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            d, other = flat.field("d").to_numpy(), flat.field("id").to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rho = np.full(len(sizes), np.inf)
            np.minimum.at(rho, owner, np.where(d > 0, d, np.inf))
            rho[~np.isfinite(rho)] = 0
            over, want = np.maximum(d - rho[owner], 0), np.log2(np.maximum(sizes, 2))
            low, high, sigma = np.zeros(len(sizes)), np.full(len(sizes), np.inf), np.ones(len(sizes))
            for _ in range(64):
                total = np.bincount(owner, np.exp(-over / sigma[owner]), len(sizes))
                much = total > want
                high, low = np.where(much, sigma, high), np.where(much, low, sigma)
                sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
            mean = np.bincount(owner, d, len(sizes)) / np.maximum(sizes, 1)
            sigma = np.maximum(sigma, 1e-3 * np.maximum(mean, 1e-12))
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(other), pa.array(np.exp(-over / sigma[owner]))], ["id", "other", "weight"])

    one = graph.mapInArrow(scale, "id long, other long, weight double")
    pairs = one.groupBy(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).agg(F.sum("weight").alias("s"), F.count("*").alias("n"), F.max("weight").alias("m"))
    # of two weights a and b their sum and the greater one give a + b - a b
    return pairs.select("u", "v", F.when(F.col("n") > 1, F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).otherwise(F.col("s")).alias("weight"))


def _mover(strangers: np.ndarray, rate: float, epochs: int, negatives: int, seed: list[int]):
    """Moves a block's points (id, place) along their edges (u, v, weight, there) for some epochs; points without edges stay."""

    def move(places: pa.Table, edges: pa.Table) -> pa.Table:
        if not edges.num_rows or not places.num_rows:
            return places.select(["id", "place"])
        every, place = places.column("id").to_numpy(), _matrix(places.column("place"))
        u, v = edges.column("u").to_numpy(), edges.column("v").to_numpy()
        order = np.lexsort((v, u))
        u, v, weight, there = u[order], v[order], edges.column("weight").to_numpy()[order], _matrix(edges.column("there"))[order]
        ids = np.unique(u)
        rows = np.argsort(every)
        rows = rows[np.searchsorted(every[rows], ids)]
        here, u, at = place[rows], np.searchsorted(ids, u), np.minimum(np.searchsorted(ids, v), len(ids) - 1)
        # the other end: a point of the block, or one that stands still, numbered after them
        still = ids[at] != v
        at[still] = len(ids) + np.arange(int(still.sum()))
        there, weight = there[still], -2 * weight
        rng = np.random.default_rng([*seed, int(ids[0]) & 0xFFFFFFFF])
        total = np.maximum(np.bincount(u, weight / -2, len(ids)), 1e-9)
        for epoch in range(epochs):
            alpha = rate * (1 - epoch / (2 * epochs))
            gap = np.subtract(here[u].T, np.concatenate([here, there])[at].T, order="C")  # one row a component
            gap *= weight / (1 + np.einsum("ij,ij->j", gap, gap))
            np.clip(gap, -4, 4, out=gap)
            step = np.stack([np.bincount(u, g, len(ids)) for g in gap], 1)
            for _ in range(negatives):
                gap = here - strangers[rng.integers(0, len(strangers), len(ids))]
                far = (gap**2).sum(1)[:, None]
                step += np.clip(2 * gap / ((0.01 + far) * (1 + far)), -4, 4) * (far > 0) * total[:, None] / negatives
            here = here + alpha * step / np.maximum(total, 1)[:, None]
        place = place.copy()
        place[rows] = here
        flat = pa.array(np.ascontiguousarray(place).ravel(), pa.float64())
        return pa.table([pa.array(every, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1) * place.shape[1], pa.int32()), flat)], ["id", "place"])

    return move


def _block_number(cuts: list[float]):
    """How many of the ascending cuts a value is above."""

    def number(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), x.to_numpy(), "left").astype(np.int32))

    return F.pandas_udf(number, "int")


def layout(points: DataFrame, graph: DataFrame, dims: int = 5, rounds: int = 6, epochs: int = 25, negatives: int = 5, block: int = 4096, seed: int = 3) -> DataFrame:
    """(id, place array<double>): points in `dims` dimensions where neighbours stay near and strangers apart.

    Starts from the first principal components. In a round, blocks of near points move for some epochs: along their fuzzy edges,
    whose other ends stand still if they lie in other blocks, and away from random strangers of a bounded sample; then
    blocks learn where the others went.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = points.select(F.size("vector")).first()
    if width is None:
        return points.sparkSession.createDataFrame([], "id long, place array<double>")
    dims = min(dims, width[0])
    rows = points.select("id", array_to_vector("vector").alias("v"))
    start = PCA(k=dims, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("place"))
    spread = start.select(F.max(F.array_max(F.transform("place", F.abs)))).first()[0] or 1.0
    place = written(start.select("id", F.transform("place", lambda x: x * (10 / spread)).alias("place")))
    edges = fuzzy_weights(graph)
    edges = written(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    count = points.count()
    blocks = max(1, -(-count // block))
    for r in range(rounds):
        share = min(1.0, STRANGERS / count)
        sample = place.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").limit(2 * STRANGERS).collect()
        strangers = np.array([s["place"] for s in sample] or [[0.0] * dims])
        rate = 1.0 - r / rounds
        # blocks are ranges along another axis each round, so that borders move
        axis = F.get("place", F.lit(r % dims))
        cuts = place.agg(F.percentile_approx(axis, [k / blocks for k in range(1, blocks)] or [0.5], max(1000, 50 * blocks))).first()[0][: blocks - 1]
        dealt = place.withColumn("part", _block_number(cuts)(axis) if cuts else F.lit(0))
        # edges learn their block and where their other end is; the places of a block come once a point
        ends = edges.join(dealt.select(F.col("id").alias("u"), F.col("part").alias("block")), "u").join(place.select(F.col("id").alias("v"), F.col("place").alias("there")), "v")
        move = _mover(strangers, rate, epochs, negatives, [seed, r])
        after = written(dealt.groupBy("part").cogroup(ends.groupBy("block")).applyInArrow(move, "id long, place array<double>"))
        dropped(place)
        place = after
    return place
