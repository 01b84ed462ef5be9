"""Vectors of terms and texts learned from the corpus itself: positive pointwise mutual information of terms that stand near each
other, and its leading eigenvectors by a randomised block method.

The matrix is a table of its entries, a block of vectors a table with a row a term. Products are joins and sums; only square
matrices of the block's width come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import dropped, written

#: Terms that every executor may know: some 300 MB of words and numbers.
MOST_TERMS = 4_000_000
#: Terms whose vectors every executor may know at once.
SLICE_TERMS = 250_000
#: Places of texts whose pairs a task counts at once, and pairs that a task adds up at once.
AT_ONCE, PART_PAIRS = 1 << 21, 1 << 23


def _numbered(terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, place): terms of a written table numbered from 0 without gaps, partition by partition, and how many there are."""
    rows = written(terms.select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    first, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg((F.max("at") + 1).alias("n")).collect()):  # one row a task
        first[part], total = total, total + n
    starts = rows.sparkSession.createDataFrame(list(first.items()), "part int, start long")
    return written(rows.join(F.broadcast(starts), "part").select("term", (F.col("start") + F.col("at")).cast("int").alias("place"))), total


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    return codes[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on, which compress well where numbers are small."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def near_pairs(df: DataFrame, tokens: str = "tokens", window: int = 4, least: int = 1) -> DataFrame:
    """(term, other, n): how often each two terms stand at most `window` places apart, both orders; a term beside itself counts twice.

    Pairs seen fewer than `least` times are left out. A term meets at most 2 * `window` others a use, so those of too few uses
    have no pair and no number. Pairs of numbers are counted a few million at a time, then by ranges of their
    first number; these ranges move as packed arrays.
    """
    # an outer explode, since Spark would look at the tokens' size first, and make them twice for that
    words = df.select(F.col(tokens).alias("t"))
    uses = written(words.select(F.explode_outer("t").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("uses")))
    whole = uses.agg(F.sum("uses")).first()[0] or 0
    places, many = _numbered(uses.where(F.col("uses") * (2 * window) >= least))
    rows = words.withColumn("text", F.monotonically_increasing_id()).select("text", F.posexplode_outer("t").alias("at", "term"))
    if many <= MOST_TERMS:
        rows = rows.join(F.broadcast(places), "term", "left")
    else:
        rows = rows.join(places, "term", "left").repartition("text").sortWithinPartitions("text", "at")
    rows = rows.select("text", F.coalesce("place", F.lit(-1)).alias("place"))
    parts = max(1, -(-whole * window // PART_PAIRS))

    def packed(texts: np.ndarray, place: np.ndarray, sign: int = 1) -> pa.RecordBatch:
        codes = []
        for k in range(1, window + 1):
            a, b = place[:-k], place[k:]
            near = (texts[:-k] == texts[k:]) & (a >= 0) & (b >= 0)
            a, b = a[near].astype(np.int64), b[near].astype(np.int64)
            codes.append(np.minimum(a, b) * many + np.maximum(a, b))
        codes = np.sort(np.concatenate(codes))
        starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
        codes, counts = codes[starts], sign * np.diff(starts, append=len(codes)).astype(np.int32)
        part = codes // max(1, many) % parts
        order = np.argsort(part, kind="stable")
        codes, counts, cuts = codes[order], counts[order], np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        steps = np.diff(codes, prepend=0)
        steps[cuts[full]] = codes[cuts[full]]
        lists = [pa.array([_planes(x[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()) for x in (steps, counts)]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *lists], ["part", "steps", "counts"])

    def count(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("text").to_numpy(), batch.column("place").to_numpy()))
            n += batch.num_rows
            if n < AT_ONCE:
                continue
            # the last places meet those that follow, and are counted again with these
            texts, place = map(np.concatenate, zip(*held, strict=True))
            yield packed(texts, place)
            texts, place = texts[-window:], place[-window:]
            yield packed(texts, place, -1)
            held, n = [(texts, place)], len(texts)
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def add(table: pa.Table) -> pa.Table:
        total, new, held = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for steps, counts in zip(table.column("steps"), table.column("counts"), strict=True):
            new.append((np.cumsum(_numbers(steps.as_py(), np.int64)), _numbers(counts.as_py(), np.int32).astype(np.int64)))
            held += len(new[-1][0])
            if held > PART_PAIRS:
                total, new, held = _summed(*map(np.concatenate, zip(total, *new, strict=True))), [], 0
        codes, counts = _summed(*map(np.concatenate, zip(total, *new, strict=True)))
        a, b = np.divmod(codes, max(1, many))
        keep = counts * np.where(a == b, 2, 1) >= max(1, least)
        return pa.table({"a": a[keep], "b": b[keep], "n": counts[keep]})

    packs = rows.mapInArrow(count, "part int, steps binary, counts binary")
    half = packs.repartition(parts, "part").groupBy("part").applyInArrow(add, "a long, b long, n long")
    of = lambda c: places.select(F.col("place").cast("long").alias(c), F.col("term").alias(f"{c}_"))
    half = half.join(of("a"), "a").join(of("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "n")
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("other"), (2 * F.col("n")).alias("n"))))
    both = both.otherwise(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("term"), F.col("a").alias("other"), "n")))
    return half.select(F.inline(both))


def positive_pmi(pairs: DataFrame, least: int = 5, smooth: float = 0.75) -> DataFrame:
    """(term, other, weight) of pairs above chance: ln of how often two terms meet in parts of what their counts make likely.

    Pairs seen fewer than `least` times are left out first. Counts are raised to `smooth`, which keeps rare terms from
    heading every list; the table is symmetric.
    """
    pairs = written(pairs.where(F.col("n") >= least))  # read four times below
    counts = pairs.groupBy("term").agg(F.pow(F.sum("n").cast("double"), F.lit(smooth)).alias("c"))
    # the expected part of a pair is the product of the smoothed parts of its terms
    totals = pairs.agg(F.sum("n").alias("all")).crossJoin(counts.agg(F.sum("c").alias("mass")))  # one row
    of = lambda name: counts.select(F.col("term").alias(name), F.col("c").alias(f"c_{name}"))
    out = pairs.join(of("term"), "term").join(of("other"), "other").crossJoin(F.broadcast(totals))
    out = out.withColumn("weight", F.log(F.col("n") * F.col("mass") / F.col("all") * F.col("mass") / (F.col("c_term") * F.col("c_other"))))
    return out.where("weight > 0").select("term", "other", "weight")


def _sum_by(name: str, width: int):
    """For rows (`name`, place of a vector, weight): sums of weighted vectors by `name`, first within a task, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = batch.column(name).dictionary_encode()
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * batch.column("weight").to_numpy()[:, None]
            sums = np.zeros((len(keys.dictionary), width))
            np.add.at(sums, keys.indices.to_numpy(), x)
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))], [name, "vector"])

    return run


def _add_up(rows: DataFrame, name: str, width: int) -> DataFrame:
    """(name, vector): weighted vectors of (name, vector, weight) rows added up, by component."""
    partial = rows.select(name, "vector", "weight").mapInArrow(_sum_by(name, width), f"{name} string, vector array<double>")
    # a key has one partial sum a batch; these are few enough to be spread by their place in a fixed number of pieces
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(16))
    add = F.array(*[F.sum(F.get("vector", F.lit(k))).alias(f"v{k}") for k in range(width)])
    return partial.groupBy(name, piece.alias("piece")).agg(add.alias("vector")).groupBy(name).agg(add.alias("vector"))


def _gram(rows: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    """Sum of outer products of two vectors of each row: a small matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, width))
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in (left, right))
            total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["place", "x"])

    sums = rows.select(*dict.fromkeys((left, right))).mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x")).collect()
    out = np.zeros(width * width)
    for place, x in sums:
        out[place] = x
    return out.reshape(width, width)


def _times(rows: DataFrame, matrix: np.ndarray, columns: list[str]) -> DataFrame:
    """Vectors times a small matrix on their right."""
    width = matrix.shape[0]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            y = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ matrix
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(y.ravel()))], [*columns, "vector"])

    kinds = ", ".join(f"{c} string" for c in columns)
    return rows.select(*columns, "vector").mapInArrow(run, f"{kinds}, vector array<double>")


def _orthonormal(block: DataFrame, width: int) -> DataFrame:
    """The block with orthonormal columns, by the eigenvectors of its Gram matrix; directions that vanish become zero."""
    values, vectors = np.linalg.eigh(_gram(block, "vector", "vector", width))
    good = values > 1e-12 * max(values.max(initial=0), 1e-300)
    return _times(block, vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0), ["term"])


def leading_vectors(weights: DataFrame, dims: int = 50, spare: int = 10, rounds: int = 3, seed: int = 17) -> DataFrame:
    """(term, vector array<double>) from the `dims` largest eigenvalues in size of a symmetric table (term, other, weight), each scaled by the root
    of that size; signs are such that each component's greatest sum of cubes is positive.

    A block of random vectors, `spare` more than asked for, is multiplied and made orthonormal `rounds` times, then turned to
    the eigenvectors of the matrix within it. Fewer terms than dims leave zeros at the end.
    """
    width = dims + spare
    weights = written(weights.repartition("term").sortWithinPartitions("term"))  # so that a batch has few terms and sums them up

    def random_rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for t, h in zip(batch.column("term").to_pylist(), batch.column("h").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([np.random.default_rng([seed, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).normal(size=width)], pa.list_(pa.float64()))], ["term", "vector"])

    terms = weights.select("term").distinct().select("term", F.xxhash64("term").alias("h"))
    block = written(terms.mapInArrow(random_rows, "term string, vector array<double>"))
    slices = max(1, -(-block.count() // SLICE_TERMS))

    def product(b: DataFrame) -> DataFrame:
        of = lambda rows, k: rows.where(F.pmod(F.xxhash64("other"), F.lit(slices)) == k)
        b = b.withColumnRenamed("term", "other")
        return _add_up(reduce(DataFrame.unionByName, [of(weights, k).join(F.broadcast(of(b, k)), "other") for k in range(slices)]), "term", width)

    for _ in range(rounds):
        after = written(product(block))
        dropped(block)
        block = written(_orthonormal(after, width))
        dropped(after)
    image = written(block.join(product(block).withColumnRenamed("vector", "image"), "term"))
    inner = _gram(image, "vector", "image", width)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dims]
    rows = _times(image, turn[:, order], ["term"])
    cubes = rows.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x") ** 3).alias("s")).collect()
    sign = np.ones(len(order))
    for k, s in cubes:
        sign[k] = -1.0 if s < 0 else 1.0
    return _times(rows, np.diag(sign * np.sqrt(np.abs(values[order]))), ["term"])


def text_vectors(df: DataFrame, vectors: DataFrame, tokens: str = "tokens", key: str = "doc_id", smooth: float = 1e-3) -> DataFrame:
    """(key, vector): mean of the vectors of a text's terms, frequent ones counting less: smooth / (smooth + part of all terms). Texts without known terms have none."""
    width = vectors.select(F.size("vector")).first()
    if width is None:
        return df.select(key, F.array().cast("array<double>").alias("vector")).limit(0)
    # an outer explode, since Spark would look at the tokens' size first, and make them twice for that
    terms = df.select(key, F.explode_outer(tokens).alias("term"))
    uses = written(terms.where("term is not null").groupBy("term").agg(F.count("*").alias("uses")))
    whole = uses.agg(F.sum("uses")).first()[0] or 1
    known = written(vectors.join(uses, "term").select("term", "vector", (smooth / (smooth + F.col("uses") / whole)).alias("rare")))
    slices = max(1, -(-known.count() // SLICE_TERMS))
    sums = None
    for k in range(slices):  # texts meet a slice of the terms after another, so that only sums move
        part = known.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k)
        rows = terms.join(F.broadcast(part), "term")
        some = rows.groupBy(key).agg(F.sum("rare").alias("w"), *[F.sum(F.get("vector", F.lit(c)) * F.col("rare")).alias(f"v{c}") for c in range(width[0])])
        sums = some if sums is None else sums.unionByName(some)
    if slices > 1:
        sums = sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("w", *(f"v{c}" for c in range(width[0])))])
    return sums.where("w > 0").select(key, F.array(*[F.col(f"v{k}") / F.col("w") for k in range(width[0])]).alias("vector"))


def learned_vectors(df: DataFrame, tokens: str = "tokens", dims: int = 50, window: int = 4, least: int = 5) -> DataFrame:
    """(term, vector) of the terms of a corpus."""
    return leading_vectors(positive_pmi(near_pairs(df, tokens, window, least), least), dims)


def encoded(df: DataFrame, make_client, text: str = "text", name: str = "vector", at_once: int = 64) -> DataFrame:
    """`df` with array<float> `name` from an outside model: each task makes a client, which gives a vector for each of a list of texts.

    Null texts count as empty. A client that gives another number of vectors than texts is an error.
    """
    columns = list(df.columns)
    rows = df.withColumn("_encode_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    from pyspark.sql.types import ArrayType, FloatType, StructType

    def run(batches: Iterator[pa.RecordBatch]):
        client = make_client()
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                found = client(part.column("_encode_text").to_pylist())
                if len(found) != part.num_rows:
                    raise ValueError("the client must give a vector for each text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array([[float(x) for x in v] for v in found], pa.list_(pa.float32()))], [*columns, name])

    return rows.mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(FloatType())))
