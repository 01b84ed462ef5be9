"""Exact stratified samples and splits, the same for the same rows and seed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import length_bin
from ..functions.text import is_blank, split_name
from .dedup import without_overlap


def stratum(month: Column, keyword: Column, text: Column) -> Column:
    """month|keyword|length bin; missing parts are NA."""
    part = lambda c: F.when(is_blank(c), "NA").otherwise(c)
    return F.concat_ws("|", part(month), part(keyword), length_bin(F.length(F.coalesce(text, F.lit("")))))


def strata_counts(df: DataFrame, column: str = "stratum_id") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("population_count"))


def hamilton(counts: DataFrame, n: int, column: str = "stratum_id") -> DataFrame:
    """Largest-remainder allocation of n, without minimum: floor of the exact share, then one more to the largest fractions, ties by name.

    `counts` has one row a stratum and few strata: they meet in one task.
    """
    one = Window.partitionBy(F.lit(0))
    exact = F.col("population_count").cast("double") / F.sum("population_count").over(one) * n
    rows = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long")).withColumn("_left", F.lit(n) - F.sum("_floor").over(one))
    order = one.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), F.col(column).asc())
    return rows.withColumn("_rank", F.row_number().over(order)).select(column, "population_count", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("sample_count"))


def allocate(counts: dict[str, int], n: int, least: int = 0) -> dict[str, int]:
    """Rows to take of each stratum, n in all: by largest remainder, one at least of strata of `least` rows or more, never more than there are.

    What is then over or missing is taken or given one by one in turn, largest strata first, ties by name. Errors: n below 1,
    fewer rows than n, or more guaranteed strata than n.
    """
    total = sum(counts.values())
    if n < 1 or total < n:
        raise ValueError(f"can't take {n} of {total} rows")
    exact = {s: c / total * n for s, c in counts.items()}
    take = {s: int(x) for s, x in exact.items()}
    for s in sorted(counts, key=lambda s: (-round(exact[s] - take[s], 9), s))[: n - sum(take.values())]:
        take[s] += 1
    floor = {s: int(0 < least <= c) for s, c in counts.items()}
    take = {s: min(max(k, floor[s]), counts[s]) for s, k in take.items()}
    step = 1 if sum(take.values()) < n else -1
    turn = sorted(counts, key=lambda s: (-(counts if step > 0 else take)[s], s))
    while (gap := n - sum(take.values())) != 0:
        moved = 0
        for s in turn:
            if moved == abs(gap):
                break
            if take[s] < counts[s] if step > 0 else take[s] > floor[s]:
                take[s] += step
                moved += 1
        if not moved:
            raise ValueError("the guaranteed strata are more than n")
    return take


def _hash_rank(rows: DataFrame, group: str, id_col: str, seed: int, wanted: Column | None = None) -> DataFrame:
    """Adds _r, the rank from 1 of the hash of id and seed within the group, and _all, the group's rows.

    Ranks come from counts of hash prefixes, 4096 a group, then ranks within a prefix, so no group is one task. With
    `wanted`, prefixes that start after that rank are left out before any row is sorted.
    """
    rows = rows.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b")
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    rows = rows.join(sizes.drop("_n"), [group, "_b"])
    if wanted is not None:
        rows = rows.where(F.col("_start") < wanted)
    rank = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", id_col)) + F.col("_start")
    return rows.withColumn("_r", rank).drop("_h", "_b", "_start")


def sample(df: DataFrame, take: dict[str, int], id_col: str, column: str = "stratum_id", seed: int = 42) -> DataFrame:
    """Exactly take[s] rows of each stratum s: those whose id and seed hash lowest. Not a Bernoulli sample."""
    quota = df.sparkSession.createDataFrame(sorted(take.items()), f"{column} string, _take long")  # one row a stratum
    rows = _hash_rank(df.join(F.broadcast(quota), column), column, id_col, seed, F.col("_take"))
    return rows.where(F.col("_r") <= F.col("_take")).drop("_r", "_all", "_take")


def split(df: DataFrame, id_col: str, label: str | None, validation: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: train, val or test, by the rank of the id's hash within the label; sizes are exact to rounding."""
    rows = _hash_rank(df.withColumn("_l", F.coalesce(F.col(label).cast("string") if label else F.lit(""), F.lit("NA"))), "_l", id_col, seed)
    tests, vals = F.round(F.col("_all") * test), F.round(F.col("_all") * validation)
    return rows.withColumn("split", F.when(F.col("_r") <= tests, "test").when(F.col("_r") <= tests + vals, "val").otherwise("train")).drop("_l", "_all", "_r")


def split_with_fallback(df: DataFrame, id_col: str, labels: Sequence[str], **sizes) -> tuple[DataFrame, str]:
    """Split by both labels together, else by the first, the second, or none: the first choice whose classes have two rows at least."""
    choices = [("pair", list(labels)), *[(c, [c]) for c in labels]] if len(labels) > 1 else [(c, [c]) for c in labels]
    for name, columns in choices:
        smallest = df.groupBy(*columns).count().agg(F.min("count")).first()[0]
        if smallest and smallest >= 2:
            keyed = df.withColumn("_pair", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]))
            return split(keyed, id_col, "_pair", **sizes).drop("_pair"), name
    return split(df, id_col, None, **sizes), "random"


def predefined_split(df: DataFrame, column: str) -> DataFrame:
    """`split` from a column of known names for train, val and test; an error for other values or a missing part."""
    out = df.withColumn("split", split_name(column))
    found = out.agg(F.count_if(F.col("split").isNull()).alias("bad"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]).first()
    if found["bad"] or not all(found[s] for s in ("train", "val", "test")):
        raise ValueError(f"unusable split column {column}: {found.asDict()}")
    return out


def assembled_split(pool: DataFrame | None, explicit: dict[str, DataFrame], id_col: str, labels: Sequence[str], source: str = "source", **sizes) -> tuple[DataFrame, dict]:
    """One table with `split` from a pool to be split and from rows whose split is given (`explicit`: train, val, test), and a report.

    Rows of the pool that equal a given row on all columns they share are left out first; the rest is split as by
    `split_with_fallback`. Columns are aligned by name. All three parts must have rows. The report has the strategy, how many
    rows of the pool were left out, the sizes of splits and the rows of each source in them.
    """
    if odd := set(explicit) - {"train", "val", "test"}:
        raise ValueError(f"unknown splits {sorted(odd)}")
    union = lambda tables: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    given = [df.withColumn("split", F.lit(name)) for name, df in explicit.items()]
    parts, strategy, removed = list(given), "predefined_only", 0
    if pool is not None:
        left = without_overlap(pool, union(given).drop("split")) if given else pool
        removed = pool.count() - left.count() if given else 0
        if left.limit(1).count():
            shared, strategy = split_with_fallback(left, id_col, labels, **sizes)
            parts = [shared, *given]
    if not parts:
        raise ValueError("neither a pool nor given rows")
    out = union(parts)
    counts = {(r["split"], r[source]): r["rows"] for r in split_manifest(out, source).collect()} if source in out.columns else {(r["split"], None): r["count"] for r in out.groupBy("split").count().collect()}
    totals = {s: sum(n for (t, _), n in counts.items() if t == s) for s in ("train", "val", "test")}
    if missing := [s for s, n in totals.items() if not n]:
        raise ValueError(f"no rows for {missing}")
    report = {"split_strategy": strategy, "pool_overlap_removed": removed, "split_sizes": totals, "source_breakdown": {s: {str(k): n for (t, k), n in sorted(counts.items(), key=str) if t == s} for s in totals}}
    return out, report


def split_manifest(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy("split", source).agg(F.count("*").alias("rows"))


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id", shard_rows: int = 100_000) -> DataFrame:
    """Numbers from 0 in the order of a hash of `order`, which should tell rows apart.

    Shards are ranges of the hash of about `shard_rows` rows, so no task sees all rows and their number changes no row's.
    """
    bits = max(256, df.count() // shard_rows).bit_length()
    rows = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.shiftright("_h", 64 - bits))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rows = rows.join(sizes, "_b")  # one row a shard
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy("_h", *order)) - 1 + F.col("_start")).drop("_h", "_b", "_start")
