"""Keep-first deduplication, anti-joins against state, and signatures of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_hash


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key that comes first in `order`, which should be total.

    An aggregate of least structs, so copies are folded before the shuffle and a hot key is no large group.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    picked = F.min(F.struct(*ranks, *[F.col(f"`{c}`") for c in rest])).alias("_first")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(picked)
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def without_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the state table."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def dedup_by_id(df: DataFrame, seen: DataFrame, order: Sequence[Column | str], id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows (with their id's hash as `h`), and one row of counters, and the hashes to add to the state.

    Ids are trimmed, blank ones dropped, the first row of an id kept, ids of the state dropped.
    """
    rows = df.withColumn(id_col, strip(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    named = rows.where(F.col(id_col) != "")
    first = keep_first(named, [id_col], order).withColumn("h", text_hash(id_col))
    new = without_seen(first, seen, "h")
    count = lambda d, name: d.agg(F.count("*").alias(name))
    counts = rows.agg(F.count("*").alias("incoming_rows"), F.count_if(F.col(id_col) == "").alias("missing_id_rows"))
    counts = counts.crossJoin(count(first, "_first")).crossJoin(count(new, "appended_rows"))  # one row each
    counts = counts.select("incoming_rows", "missing_id_rows", (F.col("incoming_rows") - F.col("missing_id_rows") - F.col("_first")).alias("batch_dedup_removed"), (F.col("_first") - F.col("appended_rows")).alias("existing_dedup_removed"), "appended_rows")
    return new, counts, new.select("h")


def dedup_by_text(df: DataFrame, seen: DataFrame, order: Sequence[Column | str], text_col: str = "cleaned_text") -> DataFrame:
    """The first row of each text that the state table of hashes doesn't have; all rows of blank text count as one text."""
    return without_seen(keep_first(df.withColumn("h", text_hash(text_col)), ["h"], order), seen, "h")


def signature(columns: Sequence[str]) -> Column:
    """64-bit hash of the columns as text; null and empty are the same."""
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def without_overlap(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of `df` that equal no row of `reference` on all the columns they share."""
    common = sorted(set(df.columns) & set(reference.columns))
    if not common:
        return df
    known = reference.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_r{k}") for k, c in enumerate(common)]).distinct()
    keyed = df.withColumns({f"_r{k}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for k, c in enumerate(common)})
    names = [f"_r{k}" for k in range(len(common))]
    return keyed.join(known, names, "left_anti").drop(*names)


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size and time the manifest doesn't have."""
    return found.join(manifest.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")


def resumed(rows: DataFrame, earlier: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """`rows` with the outputs that an earlier run gave to the same rows; repeated rows are matched one to one, in order of a hash of the row and of the outputs."""
    from pyspark.sql import Window

    identity = [c for c in rows.columns if c in earlier.columns and c not in outputs]
    number = lambda *order: F.row_number().over(Window.partitionBy("_sig").orderBy(*order))
    a = rows.withColumn("_sig", signature(identity)).withColumn("_n", number(signature(rows.columns)))
    b = earlier.withColumn("_sig", signature(identity)).withColumn("_n", number(*outputs)).select("_sig", "_n", *outputs)
    return a.drop(*outputs).join(b, ["_sig", "_n"], "left").drop("_sig", "_n")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells whether two tables hold the same rows, in any order: count and sums of hashes, hashed."""
    h = signature(df.columns)
    return df.agg(F.count("*").alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x")).select(F.sha2(F.concat_ws("|", "_n", "_s", "_x"), 256).alias("fingerprint"))
