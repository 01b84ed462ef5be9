"""Drift between neighbouring periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import js_divergence
from .ranking import first_of, top_n
from .shares import running_periods


def _aligned(rows: DataFrame, groups: Sequence[str], period: str, item: str, value: str) -> DataFrame:
    """Each item of two neighbouring periods with its value in both (null where it is missing).

    Each row goes to the pair where its period is the current and to the one where it is the previous; items meet in one
    aggregate, so no full outer join of the table with itself is needed.
    """
    pairs = running_periods(rows, groups, period)
    now = pairs.select(*groups, F.col("current_period").alias(period), "previous_period", "current_period", F.lit(1).alias("_side"))
    before = pairs.select(*groups, F.col("previous_period").alias(period), "previous_period", "current_period", F.lit(0).alias("_side"))
    both = rows.select(*groups, period, item, value).join(now.unionByName(before), [*groups, period])
    return both.groupBy(*groups, "previous_period", "current_period", item).agg(
        F.max(F.when(F.col("_side") == 0, F.col(value))).alias("previous"), F.max(F.when(F.col("_side") == 1, F.col(value))).alias("current")
    )


def ranked_term_drift(terms: DataFrame, term: str = "term", score: str = "pmi", rank: str = "term_rank", n: int = 20, keyword: str = "keyword", period: str = "period_label") -> DataFrame:
    """How each keyword's n best terms change from one period to the next; the ALL and NA levels are left out.

    Scores count as weights: where those of a period add up to nothing or less there is no divergence (null), single negative
    ones add nothing to it. Lists are sorted.
    """
    rows = terms.where(~F.col(period).isin("ALL", "NA"))
    best = top_n(rows, [keyword, period], [F.col(score).desc(), F.col(rank).asc(), F.col(term).asc()], n, "_n")
    both = _aligned(best.select(keyword, period, term, F.col(score).cast("double").alias("_score")), [keyword], period, term, "_score")
    keys = [keyword, "previous_period", "current_period"]
    whole = Window.partitionBy(*keys)
    p, q = F.coalesce("previous", F.lit(0.0)), F.coalesce("current", F.lit(0.0))
    both = both.withColumn("_p", F.try_divide(p, F.sum(p).over(whole))).withColumn("_q", F.try_divide(q, F.sum(q).over(whole)))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(term)))), " | ")  # noqa: E731  at most 2n terms
    old, new = F.col("previous").isNotNull(), F.col("current").isNotNull()
    fits = (F.sum(p) > 0) & (F.sum(q) > 0)
    return both.groupBy(*keys).agg(
        F.count_if(old & new).alias("overlap_count"),
        (F.count_if(old & new) / F.count("*")).alias("jaccard_top_terms"),
        F.when(fits, js_divergence(F.col("_p"), F.col("_q"))).alias("js_divergence"),
        listed(old & new).alias("overlap_terms"), listed(~old & new).alias("added_terms"), listed(old & ~new).alias("removed_terms"),
    )


def share_drift(shares: DataFrame, groups: Sequence[str] = (), period: str = "period_label", topic: str = "topic_id") -> DataFrame:
    """Divergence of topic shares between neighbouring periods of each group, and how many topics either has."""
    both = share_change(shares, groups, period, topic)
    keys = [*groups, "previous_period", "current_period"]
    whole = Window.partitionBy(*keys)
    both = both.withColumn("_p", F.try_divide("previous_share", F.sum("previous_share").over(whole))).withColumn("_q", F.try_divide("current_share", F.sum("current_share").over(whole)))
    return both.groupBy(*keys).agg(F.when((F.sum("previous_share") > 0) & (F.sum("current_share") > 0), js_divergence(F.col("_p"), F.col("_q"))).alias("topic_js_divergence"), F.count("*").alias("topic_count"))


def share_change(shares: DataFrame, groups: Sequence[str] = (), period: str = "period_label", topic: str = "topic_id") -> DataFrame:
    """Each topic's share in two neighbouring periods, 0 where it is missing, and the difference."""
    both = _aligned(shares.where(F.col(period) != "NA"), list(groups), period, topic, "doc_share")
    both = both.withColumn("previous_share", F.coalesce("previous", F.lit(0.0))).withColumn("current_share", F.coalesce("current", F.lit(0.0))).drop("previous", "current")
    return both.withColumn("share_delta", F.col("current_share") - F.col("previous_share"))


def watch_list(tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """The pair of largest drift of each focus in several drift tables (table, focus columns, score column), largest first.

    Scores that differ by less than 1e-9, as sums in another order may, are equal; of those the earliest period counts.
    """
    out = None
    for source, (df, focus, score) in tables.items():
        known, order = df.where(F.col(score).isNotNull()), [F.round(score, 9).desc(), F.col("current_period").asc()]
        top = first_of(known, focus, order) if focus else known.orderBy(*order).limit(1)
        top = top.select(F.lit(source).alias("drift_source"), F.concat_ws(" / ", *[F.col(c).cast("string") for c in focus]).alias("focus"), "previous_period", "current_period", F.col(score).alias("drift_score"))
        out = top if out is None else out.unionByName(top)
    return out
