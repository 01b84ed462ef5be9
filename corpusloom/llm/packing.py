"""Length buckets that waste the least padding, and token-budget batches inside each.

The lengths of the whole corpus become one histogram, exact to length EXACT. Dynamic programming over it picks the bucket
boundaries with the least total padding. Each bucket is then cut into batches that, padded to the bucket's bound, fit a budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

BUCKETS, BUDGET = 16, 16_384
#: The histogram has a bin for every length to EXACT and PER_OCTAVE bins an octave above, so some 1.2 million at most. A
#: bucket above EXACT ends at the largest length of a bin: its rows are padded by at most 1/PER_OCTAVE more than at best.
EXACT, PER_OCTAVE = 1 << 20, 1 << 12
#: Rows that are numbered in one task, and equal rows that are numbered as one.
SHARD_ROWS, RUN = 100_000, 4096
TEXT_WORDS = "cast(regexp_count(coalesce(text, ''), '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+') as long)"


def bin_of(length: Column) -> Column:
    """Bins in order of length."""
    octave = F.floor(F.log2(length.cast("double"))).cast("long")
    step = F.floor((length.cast("double") / F.pow(F.lit(2.0), octave) - 1) * PER_OCTAVE).cast("long")
    return F.when(length <= EXACT, length).otherwise(octave * PER_OCTAVE + step + EXACT)


def _layer(before: np.ndarray, bound: np.ndarray, rows: np.ndarray, mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j bins in k buckets, and where the last bucket starts, from that in k - 1 buckets.

    The best start never falls as j grows, so a middle j halves the starts that those on either side of it must try. All
    middles of one depth are tried together.
    """
    n = len(bound)
    least, cut = np.full(n + 1, 1 << 62), np.zeros(n + 1, np.int32)
    low, high, first, last = (np.array([x], np.int64) for x in (k, n, k - 1, n - 1))
    while len(low):
        mid = (low + high) // 2
        tries = np.minimum(last, mid - 1) - first + 1
        at = np.cumsum(tries) - tries
        which = np.repeat(np.arange(len(mid)), tries)
        i, j = first[which] + np.arange(len(which)) - at[which], mid[which]
        cost = before[i] + bound[j - 1] * (rows[j] - rows[i]) - (mass[j] - mass[i])
        least[mid] = np.minimum.reduceat(cost, at)
        best = np.flatnonzero(cost == least[j])
        cut[mid] = i[best[np.searchsorted(which[best], np.arange(len(mid)))]]
        left, right = low < mid, mid < high
        low, high, first, last = (np.concatenate([a[left], b[right]]) for a, b in ((low, mid + 1), (mid - 1, high), (first, cut[mid]), (cut[mid], last)))
    return least, cut


def boundaries(bound: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket bounds, at most `buckets`, with the least sum of (bound of its bucket - length) over all rows.

    `bound`, `count` and `total` are the largest length, the rows and the sum of lengths of each bin, in order. Of
    equal solutions the one with fewer and smaller bounds.
    """
    n = len(bound)
    rows, mass = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (count, total))
    now, cuts = np.full(n + 1, 1 << 62), []
    now[0] = 0
    answer, chosen = np.inf, 0
    for k in range(1, min(buckets, n) + 1):
        now, cut = _layer(now, bound, rows, mass, k)
        cuts.append(cut)
        if now[n] < answer:
            answer, chosen = now[n], k
    out, j = [], n
    for k in range(chosen - 1, -1, -1):
        out.append(int(bound[j - 1]))
        j = int(cuts[k][j])
    return out[::-1]


def packed(rows: DataFrame, length: str | Column = "n_tokens", id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch_id, slot, batch_rows and padding (all long) of each row.

    Rows of a bucket are numbered by a hash of id and length and cut into batches of `budget` // bucket_length rows;
    batch_id is unique in the result, and the same on every cluster. A row longer than the budget is a batch of its own
    bucket's length with one slot. Null lengths count as 0; rows of equal id and length, which are interchangeable, are
    counted and numbered RUN at a time, so a repeated or null id is no task of its own. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    size = length if isinstance(length, Column) else F.col(f"`{length}`")
    lengths = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    distinct = materialise(lengths.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")))
    total = F.sum(F.col("n_tokens") * F.col("copies"))
    bins = distinct.groupBy(bin_of(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("bound"), F.sum("copies").alias("rows"), total.alias("total")).toArrow().sort_by("bin")  # bounded by the number of bins
    bound, count, total = (bins.column(c).to_numpy() for c in ("bound", "rows", "total"))
    bounds = boundaries(bound, count, total, buckets) if len(bound) else [0]
    bucket = F.lit(0)
    for k, b in enumerate(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") > b, k + 1).otherwise(bucket)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    # runs of equal rows in an order that a hash gives; shards are ranges of the hash, so their number changes no place
    shards = max(int(count.sum()) // SHARD_ROWS, 2 * shuffle_partitions(spark), 2).bit_length()
    keyed = distinct.withColumn("bucket", bucket.cast("long")).withColumn("_run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")))
    keyed = keyed.withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("_run") * RUN)).withColumn("_key", F.xxhash64("doc_id", "n_tokens", "_run"))
    keyed = keyed.withColumn("shard", F.shiftright("_key", 64 - shards))
    inner = Window.partitionBy("bucket", "shard").orderBy("_key", "doc_id", "n_tokens", "_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("bucket", "shard").agg(F.sum("copies").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    whole = sizes.groupBy("bucket").agg(F.sum("_n").alias("_all"))  # one row a bucket
    out = keyed.withColumn("_at", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(starts, ["bucket", "shard"]).join(F.broadcast(whole), "bucket")
    out = out.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("_at", F.col("_at") + F.col("_start") + F.col("_copy"))
    out = out.withColumn("bucket_length", F.element_at(limits, F.col("bucket").cast("int") + 1))
    out = out.withColumn("_per", F.greatest(F.expr(f"{budget} div greatest(bucket_length, 1)"), F.lit(1))).withColumn("_batch", F.expr("_at div _per"))
    return out.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", (F.col("bucket") * F.lit(1 << 48) + F.col("_batch")).alias("batch_id"), (F.col("_at") % F.col("_per")).alias("slot"),
        F.least("_per", F.col("_all") - F.col("_batch") * F.col("_per")).alias("batch_rows"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Tokens are the words between ASCII white space."""
    return packed(table(spark, sf_dir, "documents"), F.expr(TEXT_WORDS))
