"""Registered queries of models and streams. Most are beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, sampling
from ..sources.sinks import shared_folder
from ..streaming import ingest
from . import ml, training


def kmeans_topics(spark, sf) -> DataFrame:
    return ml.topics(spark.read.parquet(f"{sf}/embeddings.parquet"))


def outlier_reduction(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return ml.adopt_outliers(ml.topics(e, farthest=1.2), e, 0.1)


def _labelled(spark, sf) -> DataFrame:
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return sampling.split(marks.join(docs, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")), "doc_id", "label")


def train_classifier(spark, sf) -> DataFrame:
    """Metrics of a toxicity classifier on its three splits."""
    return ml.train(_labelled(spark, sf), regularisation=(0.01,))[1]


def train_on_tasks(spark, sf) -> DataFrame:
    """Metrics of a network for toxicity on its three splits, trained by two tasks together."""
    rows = _labelled(spark, sf)
    network, _ = training.train_network(rows, epochs=4, tasks=2)
    return evaluation.metrics(training.network_predictions(rows.withColumn("gold_label", F.col("label").cast("int")), network), ["split"])


def batch_predict(spark, sf) -> DataFrame:
    rows = _labelled(spark, sf)
    model, _ = ml.train(rows, regularisation=(0.01,))
    out = ml.predict(spark.read.parquet(f"{sf}/documents.parquet"), model)
    return out.select("doc_id", "pred_label", "pred_label_text", "pred_prob_1", "pred_prob_0", "pred_confidence")


def score_quality_of_scores(spark, sf) -> DataFrame:
    """Area under the curve of text length as a predictor of quality."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return evaluation.auc_by_rank(marks.join(docs, "doc_id"), "quality", "n_chars")


def label_posts_stub(spark, sf) -> DataFrame:
    """Labelling through a client that answers by a rule, as no model service is at hand."""

    def make():
        return lambda prompt: '{"label": 1' if len(prompt) % 5 == 0 else "```json\n{'tangping_related_label': '%s', 'confidence': 'high', 'exclusion_type': '游戏', 'reason': 'r',}\n```" % ("相关" if "the" in prompt else "无关")

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return ml.label_posts(docs, make, lambda t: t).select("doc_id", "label", "exclusion", "confidence", "reason", "problem")


def streaming_period_counts(spark, sf) -> DataFrame:
    """Events of each type and day, read as a stream until it is used up."""
    stream = ingest.document_stream(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet")
    counts = ingest.period_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    name = f"counts_{abs(hash(sf)) % 10**8}"
    place = shared_folder(spark)
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{place}/{name}-{query_number(spark)}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def query_number(spark) -> int:
    return spark._jvm.java.lang.System.nanoTime()


QUERIES = {f.__name__: f for f in (kmeans_topics, outlier_reduction, train_classifier, train_on_tasks, batch_predict, score_quality_of_scores, label_posts_stub, streaming_period_counts)}
SQL = {
    "label_posts_stub": """WITH s AS (SELECT doc_id, CASE WHEN length(text) > 1200 THEN substring(text, 1, 600) || ' … ' || right(text, 600) ELSE coalesce(text, '') END AS asked FROM documents),
 k AS (SELECT doc_id, CASE WHEN length(asked) % 5 = 0 THEN 0 WHEN contains(asked, 'the') THEN 1 ELSE 2 END AS k FROM s)
 SELECT doc_id, ['无关', '相关', '无关'][k + 1] AS label, ['其他', '无', '游戏二次元'][k + 1] AS exclusion, CASE WHEN k = 0 THEN '低' ELSE '高' END AS confidence, CASE WHEN k = 0 THEN '' ELSE 'r' END AS reason, CASE WHEN k = 0 THEN 'not_object' ELSE '' END AS problem FROM k""",
    "score_quality_of_scores": "WITH s AS (SELECT quality AS g, n_chars AS x FROM labels JOIN documents USING (doc_id)), c AS (SELECT x, count(*) FILTER (WHERE g = 1) AS p, count(*) FILTER (WHERE g = 0) AS n FROM s GROUP BY x), w AS (SELECT p * (coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w, p, n FROM c) SELECT sum(w) / (sum(p) * sum(n)) AS auc FROM w",
    "streaming_period_counts": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS doc_count FROM events GROUP BY ALL",
}
