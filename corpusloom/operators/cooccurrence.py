"""Terms of a keyword's documents: frequencies, association scores, and neighbours by vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cosine, lift, pmi
from .ranking import top_n

ALL = "ALL"


def term_counts(df: DataFrame, tokens: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, term, doc_freq, term_freq): documents that have the term, and its uses, in one pass over the tokens.

    The tokens of a document are sorted, and the first of equal ones counts the document. Outer, as Spark would look at the
    tokens' size first otherwise, and make them twice for that.
    """
    rows = df.select(*groups, F.sort_array(tokens).alias("_sorted"))
    pairs = F.arrays_zip(F.col("_sorted").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "_sorted").alias("before"))
    rows = rows.select(*groups, F.inline_outer(pairs).alias("term", "_before")).where("term is not null")  # the last has only a term before it
    first = F.when(F.col("term").eqNullSafe(F.col("_before")), 0).otherwise(1)
    return rows.groupBy(*groups, "term").agg(F.sum(first).alias("doc_freq"), F.count("*").alias("term_freq"))


def doc_freq(df: DataFrame, tokens: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, term, doc_freq): documents that have the term."""
    return term_counts(df, tokens, groups).drop("term_freq")


def term_freq(df: DataFrame, tokens: str, groups: Sequence[str] = ()) -> DataFrame:
    return term_counts(df, tokens, groups).drop("doc_freq")


def score_terms(df: DataFrame, keyword: str = "keyword", period: str = "period_label", tokens: str = "tokens", min_doc_freq: int = 5, top_k: int = 50, never: Sequence[str] = (), rollup: bool = True) -> DataFrame:
    """Best terms of each keyword in each period, and over all periods under the label ALL.

    df and tf count the term among the keyword's documents, the reference counts among all of the period. Terms equal to
    the keyword or in `never` are left out. Rank by pmi, document and term frequency, all descending, then term.
    """
    levels = F.explode(F.array(F.lit(ALL), F.col("period_label"))) if rollup else F.col("period_label")
    rows = df.select(F.col(keyword).alias("keyword"), F.col(period).alias("period_label"), F.col(tokens).alias("_tokens"))
    keys = ["keyword", "period_label"]
    docs = rows.groupBy(*keys).agg(F.count("*").alias("_n")).select("keyword", levels.alias("period_label"), "_n")
    docs = docs.groupBy(*keys).agg(F.sum("_n").alias("doc_count_in_keyword"))
    docs = docs.withColumn("doc_count_in_reference", F.sum("doc_count_in_keyword").over(Window.partitionBy("period_label")))
    # tokens are counted once, by period; the level over all periods and the reference are sums of those counts
    counts = term_counts(rows, "_tokens", keys).select("keyword", levels.alias("period_label"), "term", "doc_freq", "term_freq")
    counts = counts.repartition("period_label", "term").groupBy(*keys, "term").agg(F.sum("doc_freq").alias("term_doc_freq"), F.sum("term_freq").alias("term_tf"))
    counts = counts.withColumn("reference_doc_freq", F.sum("term_doc_freq").over(Window.partitionBy("period_label", "term")))
    out = counts.where((F.col("term_doc_freq") >= min_doc_freq) & (F.col("term") != F.col("keyword")))
    if never:
        out = out.where(~F.col("term").isin(list(never)))
    out = out.join(docs, keys)
    c = F.col
    out = out.withColumn("term_doc_rate", c("term_doc_freq") / c("doc_count_in_keyword")).withColumn("reference_doc_rate", c("reference_doc_freq") / c("doc_count_in_reference"))
    out = out.withColumn("pmi", pmi(c("term_doc_freq"), c("doc_count_in_reference"), c("doc_count_in_keyword"), c("reference_doc_freq")))
    out = out.withColumn("lift", lift(c("term_doc_freq"), c("doc_count_in_reference"), c("doc_count_in_keyword"), c("reference_doc_freq")))
    order = [c("pmi").desc(), c("term_doc_freq").desc(), c("term_tf").desc(), c("term").asc()]
    return top_n(out, keys, order, top_k, "term_rank").select(
        "keyword", "period_label", "doc_count_in_keyword", "doc_count_in_reference", "term", "term_doc_freq", "term_tf", "term_doc_rate", "reference_doc_freq", "reference_doc_rate", "pmi", "lift", "term_rank"
    )


def semantic_neighbors(terms: DataFrame, vectors: DataFrame, pool: int = 200, top_k: int = 20) -> DataFrame:
    """Of each keyword's `pool` best terms by pmi, the `top_k` nearest to the keyword's vector (term, vector)."""
    picked = top_n(terms, ["keyword", "period_label"], [F.col("pmi").desc(), F.col("term_doc_freq").desc(), F.col("term").asc()], pool, "_pool")
    of = lambda name: vectors.select(F.col("term").alias(name), F.col("vector").alias(f"_{name}"))
    near = picked.join(of("keyword"), "keyword").join(of("term"), "term").withColumn("embedding_similarity", cosine(F.col("_keyword"), F.col("_term")))
    near = top_n(near, ["keyword", "period_label"], [F.col("embedding_similarity").desc_nulls_last(), F.col("term").asc()], top_k, "neighbor_rank")
    return near.select("keyword", "period_label", "neighbor_rank", F.col("term").alias("neighbor_term"), "embedding_similarity", "term_doc_freq", "term_doc_rate", "pmi")


def class_tfidf(df: DataFrame, topic: str, tokens: str, top_k: int = 10) -> DataFrame:
    """Best terms of each topic by class-based TF-IDF: share in the topic times ln(1 + mean words of a topic / uses of the term)."""
    counts = term_freq(df, tokens, [topic])
    words = counts.groupBy(topic).agg(F.sum("term_freq").alias("_words"))  # one row a topic
    mean = words.agg(F.avg("_words").alias("_mean"))  # one row
    uses = counts.groupBy("term").agg(F.sum("term_freq").alias("_uses"))
    out = counts.join(uses, "term").join(F.broadcast(words), topic).crossJoin(F.broadcast(mean))
    out = out.withColumn("term_weight", F.col("term_freq") / F.col("_words") * F.log1p(F.col("_mean") / F.col("_uses")))
    return top_n(out, [topic], [F.col("term_weight").desc(), F.col("term").asc()], top_k, "term_rank").select(F.col(topic).alias("topic_id"), "term_rank", "term", "term_weight")
