"""Rank-type windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1. Spark cuts groups to n rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= n)


def first_of(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, groups, order, 1, "_first").drop("_first")


def share_of(value: str | Column, groups: Sequence[str]) -> Column:
    """A value's part of the group's total; 0 where the total is."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.try_divide(value.cast("double"), F.sum(value).over(Window.partitionBy(*groups))), F.lit(0.0))


def tiered_top_n(df: DataFrame, groups: Sequence[str], preferred: Column, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Preferred rows first, others to fill up to n."""
    return top_n(df, groups, [F.coalesce(preferred, F.lit(False)).desc(), *order], n, rank)


def ordered_terms(term: str, order: str | Column, limit: int, separator: str) -> Column:
    """Aggregate: the first `limit` terms by rank, joined. Groups must be small, as those of top-n tables are."""
    key = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(term).alias("t"))))
    return F.array_join(F.transform(F.slice(pairs, 1, limit), lambda p: p["t"]), separator)
