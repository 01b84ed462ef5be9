"""Macro topics: topics put together by hand-made ids and ordered rules, and tables over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_of, ordered_terms, share_of

ACTIONS = ("omit", "weak", "keep")  # in order of priority

Rule = tuple[str, str, Sequence[str]]


def assign_macro(df: DataFrame, by_id: Mapping[int, tuple[str, str]], rules: Sequence[Rule], fallbacks: Sequence[Rule], other: tuple[str, str], text: Column, topic: str = "topic_id") -> DataFrame:
    """Adds macro_topic, report_action and merge_source: by id, else the first rule and then fallback whose marker the text contains, else other.

    A rule is (macro topic, action, markers). Rules and ids are the caller's.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    answer = lambda macro, action, source: F.struct(F.lit(macro).alias("macro_topic"), F.lit(action).alias("report_action"), F.lit(source).alias("merge_source"))
    hit = lambda markers: lower.rlike("|".join("\\Q" + m.lower() + "\\E" for m in markers))
    steps = [F.when(F.col(topic) == F.lit(k), answer(*v, "manual")) for k, v in by_id.items()]
    steps += [F.when(hit(m), answer(a, b, "rule")) for a, b, m in rules] + [F.when(hit(m), answer(a, b, "fallback")) for a, b, m in fallbacks]
    return df.withColumn("_m", F.coalesce(*steps, answer(*other, "fallback-other"))).select("*", "_m.*").drop("_m")


def macro_shares(shares: DataFrame, mapping: DataFrame, excluded: Sequence[str] = (), period: str = "period_label") -> DataFrame:
    """Documents of each macro topic in each period and their share; topics without one count in the total."""
    rows = shares.where(~F.col(period).isin(list(excluded))) if excluded else shares
    counts = rows.join(F.broadcast(mapping.select("topic_id", "macro_topic")), "topic_id", "left").groupBy("macro_topic", period).agg(F.sum("doc_count").alias("doc_count"))
    return counts.withColumn("doc_share", share_of("doc_count", [period]))


def macro_overview(topics: DataFrame, shares: DataFrame, period: str = "period_label") -> DataFrame:
    """Of each macro topic: strongest action, topics, documents and their share, first ids, example terms and peak period."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("report_action"))
    ranked = topics.withColumn("_r", F.row_number().over(Window.partitionBy("macro_topic").orderBy(F.col("doc_count").desc(), F.col("topic_id").asc()))).withColumn("_id", F.col("topic_id").cast("string"))
    out = ranked.groupBy("macro_topic").agg(
        F.max_by("report_action", rank).alias("report_action"), F.count("*").alias("topic_n"), F.sum("doc_count").alias("doc_n"),
        ordered_terms("_id", "_r", 10, ", ").alias("top_topic_ids"), ordered_terms("top_terms", "_r", 3, " || ").alias("example_terms"),
    )
    out = out.withColumn("share_of_clustered_docs_pct", F.col("doc_n") * 100.0 / F.sum("doc_n").over(Window.partitionBy(F.lit(0))))  # one row a macro topic
    peak = first_of(shares, ["macro_topic"], [F.col("doc_share").desc(), F.col("doc_count").desc(), F.col(period).asc()])
    return out.join(peak.select("macro_topic", F.col(period).alias("peak_period"), F.col("doc_count").alias("peak_doc_count"), F.col("doc_share").alias("peak_doc_share")), "macro_topic", "left")


def action_share(shares: DataFrame, mapping: DataFrame, period: str = "period_label") -> DataFrame:
    rows = shares.join(F.broadcast(mapping.select("topic_id", "report_action")), "topic_id")
    return rows.groupBy(period, "report_action").agg(F.sum("doc_count").alias("doc_count"), F.sum("doc_share").alias("doc_share"))


def macro_matrix(shares: DataFrame, periods: Sequence[str], period: str = "period_label", value: str = "doc_share") -> DataFrame:
    """One row a macro topic, one column a period, 0 where there is nothing. Named periods save a pass to find them."""
    return shares.groupBy("macro_topic").pivot(period, list(periods)).agg(F.sum(value)).na.fill(0.0)


def metric_cards(topics: DataFrame) -> DataFrame:
    keep = lambda a: F.coalesce(F.sum(F.when(F.col("report_action") == a, F.col("doc_count"))), F.lit(0))
    return topics.agg(F.count("*").alias("topics"), F.count_distinct("macro_topic").alias("macro_topics"), F.sum("doc_count").alias("docs"), *[(keep(a) / F.sum("doc_count")).alias(f"{a}_share") for a in ACTIONS])


def sweep_gate(topics: DataFrame, outlier: int = -1) -> DataFrame:
    """Whether a topic model is usable: share of outliers, number of topics and share of the ten largest, and both gates."""
    total = F.sum("doc_count").over(Window.partitionBy(F.lit(0)))  # one row a topic
    ranked = topics.withColumn("_t", total).withColumn("_out", F.col("topic_id") == outlier).withColumn("_r", F.row_number().over(Window.partitionBy("_out").orderBy(F.col("doc_count").desc(), F.col("topic_id").asc())))
    out = ranked.agg(
        F.coalesce(F.sum(F.when(F.col("_out"), F.col("doc_count"))), F.lit(0)).alias("_o"), F.sum("doc_count").alias("_all"), F.count_if(~F.col("_out")).alias("topic_count"),
        F.coalesce(F.sum(F.when(~F.col("_out") & (F.col("_r") <= 10), F.col("doc_count"))), F.lit(0)).alias("_ten"), F.coalesce(F.sum(F.when(~F.col("_out"), F.col("doc_count"))), F.lit(0)).alias("_in"),
    )
    out = out.select((F.col("_o") / F.col("_all")).alias("outlier_share"), "topic_count", F.coalesce(F.try_divide("_ten", "_in"), F.lit(0.0)).alias("top10_share"))
    a = (F.col("outlier_share") <= 0.45) & F.col("topic_count").between(8, 15)
    b = (F.col("outlier_share") <= 0.05) & F.col("topic_count").between(80, 220) & (F.col("top10_share") <= 0.35)
    return out.withColumn("gate_compact", a).withColumn("gate_fine", b)
