"""Annotation tables merged cell by cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

LABELS, TEXTS = ("broad", "strict"), ("cleaned_text", "keyword")


def cell(c: str) -> Column:
    """A cell as text: whole numbers without .0, blank ones null."""
    text = F.regexp_replace(strip(F.col(c).cast("string")), "^(-?\\d+)\\.0+$", "$1")
    return F.when(is_blank(text), F.lit(None)).otherwise(text)


def looks_like_text(c: Column) -> Column:
    """Two characters or more, not only digits, and no truth value."""
    return (F.length(c) >= 2) & ~c.rlike("^\\p{Nd}+$") & ~F.lower(c).isin("true", "false")


def merge_annotations(df: DataFrame, order: Sequence[str], id_col: str = "id", text_col: str = "cleaned_text", fields: Sequence[str] = (*TEXTS, *LABELS)) -> tuple[DataFrame, DataFrame]:
    """Rows of all tables, one for each id (else text), and the conflicts.

    `order` ranks tables and rows. A field has the first value that isn't blank; one that is no text is replaced by the
    first that is. A later value that differs from it (labels 0 and 2 don't) is a conflict.
    """
    rows = df.select(*order, cell(id_col).alias("id"), *[cell(f).alias(f) for f in fields])
    rows = rows.withColumn("merge_key", F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("text:"), F.col(text_col)))).where(F.col("merge_key").isNotNull())
    rank = [F.col(o) for o in order]

    def best(f: str) -> Column:
        value = F.col(f)
        first = [looks_like_text(value).cast("int") * -1] if f in TEXTS else []
        return F.min(F.when(value.isNotNull(), F.struct(*[c.alias(f"k{n}") for n, c in enumerate([*first, *rank])], value.alias("v"))))["v"]

    merged = rows.groupBy("merge_key").agg(F.min("id").alias("id"), *[best(f).alias(f) for f in fields])
    same = lambda c, f: F.when(c == "2", "0").otherwise(c) if f in LABELS else c
    long = rows.select("merge_key", *order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), same(F.col(f), f).alias("_v")) for f in fields])).alias("_x")).select("merge_key", *order, "_x.*").where("value is not null")
    kept = merged.select("merge_key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("kept"), same(F.col(f), f).alias("_k")) for f in fields])).alias("_x")).select("merge_key", "_x.*")
    conflicts = long.join(kept, ["merge_key", "field"]).where(F.col("_v") != F.col("_k")).select("merge_key", "field", "kept", "value", *order)
    return merged, conflicts
