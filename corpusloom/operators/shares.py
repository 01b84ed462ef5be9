"""Counts and shares of topics over keyword, period and region, and tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_of, ordered_terms, share_of, top_n


def topic_share(df: DataFrame, groups: Sequence[str], topic: str = "topic_id", label: str | None = "topic_label") -> DataFrame:
    """(groups, topic, doc_count, doc_share) with the share of each group's documents; the label is the largest of the topic's."""
    counts = df.groupBy(*groups, topic).agg(*([F.max(label).alias(label)] if label else []), F.count("*").alias("doc_count"))
    return counts.withColumn("doc_share", share_of("doc_count", groups))


def topic_labels(info: DataFrame, machine: str = "topic_label_machine", name: str = "Name", topic: str = "topic_id") -> DataFrame:
    """(topic, topic_label) of each topic: the first of machine label and name that isn't blank, else Topic k. Columns that aren't there count as blank."""
    given = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in (machine, name) if c in info.columns]
    return info.select(topic, F.coalesce(*given, F.concat(F.lit("Topic "), F.col(topic).cast("string"))).alias("topic_label"))


def with_topic_labels(docs: DataFrame, labels: DataFrame, topic: str = "topic_id") -> DataFrame:
    """`docs` with their topics' labels; those of topics that have none are Outlier."""
    return docs.join(labels, topic, "left").withColumn("topic_label", F.coalesce("topic_label", F.lit("Outlier")))


def share_family(df: DataFrame, keyword: str = "keyword", period: str = "period_label", region: str = "region", topic: str = "topic_id") -> DataFrame:
    """All five share tables in one pass: by period, keyword and period, region, period and region, all three.

    `level` names the grouping; columns that it doesn't use are null.
    """
    sets = {"period": [period], "keyword_period": [keyword, period], "region": [region], "period_region": [period, region], "keyword_period_region": [keyword, period, region]}
    rows = df.groupBy(keyword, period, region, topic).agg(F.count("*").alias("_n"))  # folds documents before they are multiplied
    levels = [F.struct(F.lit(name).alias("level"), *[(F.col(c) if c in used else F.lit(None).cast("string")).alias(c) for c in (keyword, period, region)]) for name, used in sets.items()]
    out = rows.select(F.explode(F.array(*levels)).alias("g"), topic, "_n").select("g.*", topic, "_n")
    out = out.groupBy("level", keyword, period, region, topic).agg(F.sum("_n").alias("doc_count"))
    return out.withColumn("doc_share", share_of("doc_count", ["level", keyword, period, region]))


def topic_overview(df: DataFrame, terms: DataFrame | None = None, keyword: str = "keyword", period: str = "period_label", outlier: int | str = -1) -> DataFrame:
    """One row a topic: documents, shares of all and of clustered ones, first terms, peak period and dominant keyword.

    The peak is by count, then share, then the earlier period; the keyword by count, then name.
    """
    total = df.agg(F.count("*").alias("_all"), F.count_if(F.col("topic_id") != F.lit(outlier)).alias("_clustered"))
    counts = df.groupBy("topic_id").agg(F.count("*").alias("doc_count")).crossJoin(F.broadcast(total))  # one row
    clustered = F.when(F.col("topic_id") == F.lit(outlier), 0.0).otherwise(F.coalesce(F.try_divide(F.col("doc_count").cast("double"), F.col("_clustered")), F.lit(0.0)))
    out = counts.select("topic_id", "doc_count", (F.col("doc_count") / F.col("_all")).alias("share_of_all"), clustered.alias("share_of_clustered"))
    peak = first_of(topic_share(df, [period], label=None), ["topic_id"], [F.col("doc_count").desc(), F.col("doc_share").desc(), F.col(period).asc()])
    main = first_of(df.groupBy("topic_id", keyword).agg(F.count("*").alias("_n")), ["topic_id"], [F.col("_n").desc(), F.col(keyword).asc()])
    out = out.join(peak.select("topic_id", F.col(period).alias("peak_period"), F.col("doc_count").alias("peak_doc_count"), F.col("doc_share").alias("peak_doc_share")), "topic_id", "left")
    out = out.join(main.select("topic_id", F.col(keyword).alias("dominant_keyword"), F.col("_n").alias("dominant_keyword_docs")), "topic_id", "left")
    if terms is not None:
        out = out.join(terms.groupBy("topic_id").agg(ordered_terms("term", "term_rank", 10, " / ").alias("top_terms")), "topic_id", "left")
    return out


def topic_headlines(shares: DataFrame, group: str) -> DataFrame:
    """The group in which each topic has its largest share; by share, then count, then name."""
    return first_of(shares, ["topic_id"], [F.col("doc_share").desc(), F.col("doc_count").desc(), F.col(group).asc()])


def semantic_headlines(terms: DataFrame, n: int = 12) -> DataFrame:
    """First terms of each keyword over all periods; of single periods only where no keyword has the ALL level."""
    whole = terms.where(F.col("period_label") == "ALL")
    has_all = whole.agg((F.count("*") > 0).alias("_has"))
    rows = terms.crossJoin(F.broadcast(has_all)).where(~F.col("_has") | (F.col("period_label") == "ALL")).drop("_has")
    return top_n(rows, ["keyword"], [F.col("term_rank").asc(), F.col("pmi").desc(), F.col("period_label").asc(), F.col("term").asc()], n, "headline_rank")


def flatten_terms(terms: DataFrame, topic: str = "topic_id", pairs: str = "terms") -> DataFrame:
    """Rows of term and weight with their rank from an array of (term, weight) of each topic."""
    out = terms.select(F.col(topic).alias("topic_id"), F.posexplode(pairs).alias("p", "t"))
    return out.select("topic_id", (F.col("p") + 1).alias("term_rank"), F.col("t")["term"].alias("term"), F.col("t")["weight"].cast("double").alias("term_weight"))


def base_counters(df: DataFrame, region: str = "region", missing: str = "UNKNOWN_IP") -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.avg((F.col(region) == missing).cast("double")).alias("missing_rate"), F.count_distinct(F.when(F.col(region) != missing, F.col(region))).alias("region_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; null as NA."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("value")).agg(F.count("*").alias("rows"))


def running_periods(df: DataFrame, groups: Sequence[str], period: str) -> DataFrame:
    """(groups, previous_period, current_period) of neighbouring periods."""
    periods = df.select(*groups, period).distinct()
    lag = F.lag(period).over(Window.partitionBy(*groups).orderBy(period)) if groups else F.lag(period).over(Window.partitionBy(F.lit(0)).orderBy(period))
    return periods.withColumn("previous_period", lag).where(F.col("previous_period").isNotNull()).withColumnRenamed(period, "current_period")


def ordered_labels(df: DataFrame, column: str, last: str) -> DataFrame:
    """(column, ord): each label once, numbered from 1 by name, `last` (the label of unknown ones) at the end; null and blank ones are left out.

    Period labels of one kind sort by name as they do by time.
    """
    found = df.select(F.col(column).cast("string").alias(column)).where(F.coalesce(F.col(column), F.lit("")) != "").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy((F.col(column) == last).asc(), F.col(column).asc())  # one row a label
    return found.withColumn("ord", F.row_number().over(order))


def period_order(df: DataFrame, period: str = "period_label") -> DataFrame:
    return ordered_labels(df, period, "NA")


def region_order(df: DataFrame, region: str = "ip_normalized", unknown: str = "UNKNOWN_IP") -> DataFrame:
    return ordered_labels(df, region, unknown)
