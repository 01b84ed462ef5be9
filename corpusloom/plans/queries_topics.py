"""Registered queries on neighbours, density topics and outliers, with DuckDB counterparts where SQL has any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cooccurrence, density, graph, neighbours
from . import topics
from .queries_terms import POSTS, posts, rounded


def _embeddings(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def nearest_neighbours(spark, sf) -> DataFrame:
    """15 nearest vectors of each, exact at any size."""
    points, _ = neighbours.distinct_points(_embeddings(spark, sf))
    found = neighbours.exact_neighbours(points, 15).select("id", F.posexplode("neighbours").alias("k", "n"))
    return rounded(found.select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("neighbour_rank"), F.col("n.id").alias("neighbour"), F.col("n.d").alias("distance")), 5)


def reachability_forest(spark, sf) -> DataFrame:
    """Edges of the spanning forest of the vectors' mutual reachability, on their 15 nearest neighbours."""
    points, _ = neighbours.distinct_points(_embeddings(spark, sf))
    return rounded(graph.spanning_forest(density.mutual_reachability(neighbours.neighbour_graph(points, 15), points, 10)))


def density_topics(spark, sf) -> DataFrame:
    return rounded(topics.density_topics(_embeddings(spark, sf)))


def merged_topics(spark, sf) -> DataFrame:
    """Labels stand for topics; their ten mean vectors are merged to four."""
    e = _embeddings(spark, sf)
    return topics.merge_topics(e.select("vec_id", F.col("label").alias("topic_id"), F.lit(1.0).alias("topic_probability")), e, 4)


def _with_outliers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents with languages as topics, those of src0 as outliers, and the topics' best terms without them."""
    order = {"de": 0, "en": 1, "es": 2, "fr": 3}
    number = F.coalesce(*[F.when(F.col("keyword") == k, v) for k, v in order.items()], F.lit(4))
    docs = posts(spark, sf).select("doc_id", F.when(F.col("period_label") == "src0", -1).otherwise(number).alias("topic_id"), "tokens")
    return docs, cooccurrence.class_tfidf(docs.where("topic_id >= 0"), "topic_id", "tokens", 50)


def topic_distributions(spark, sf) -> DataFrame:
    docs, terms = _with_outliers(spark, sf)
    return rounded(topics.topic_distributions(docs, terms), 5)


def outliers_chained(spark, sf) -> DataFrame:
    docs, terms = _with_outliers(spark, sf)
    return topics.reduce_outliers(docs, "c-tf-idf+distributions", terms, least=0.3).select("doc_id", "topic_id")


def topic_memberships(spark, sf) -> DataFrame:
    """Labels stand for topics: parts of each vector's fuzzy neighbourhood that they have."""
    points, rows = neighbours.distinct_points(_embeddings(spark, sf))
    labels = rows.join(_embeddings(spark, sf).select(F.col("vec_id").alias("key"), "label"), "key").groupBy("id").agg(F.min("label").alias("topic_id"))
    return rounded(topics.memberships(neighbours.neighbour_graph(points, 15), labels), 5)


WINDOWS = f"""{POSTS}, d AS (SELECT doc_id, CASE WHEN period_label = 'src0' THEN -1 ELSE coalesce(list_position(['de', 'en', 'es', 'fr'], keyword) - 1, 4) END AS topic_id, tokens FROM posts),
 c AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, unnest(tokens) AS term FROM d WHERE topic_id >= 0) GROUP BY ALL), w AS (SELECT *, sum(tf) OVER (PARTITION BY topic_id) AS words, sum(tf) OVER (PARTITION BY term) AS uses FROM c),
 m AS (SELECT avg(words) AS mean FROM (SELECT DISTINCT topic_id, words FROM w)), best AS (SELECT topic_id, term, tf / words * ln(1 + mean / uses) AS x FROM w, m QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY x DESC, term) <= 50),
 unit AS (SELECT topic_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY topic_id)) AS x FROM best),
 win AS (SELECT doc_id, topic_id AS own, tokens, greatest(len(tokens) - 4, 0) AS last, unnest(range(greatest(len(tokens) - 4, 0) + 1)) AS s0 FROM d WHERE len(tokens) > 0),
 held AS (SELECT doc_id, own, s0, tokens[s0 + 1 : s0 + 4] AS part, list_sum(list_transform(range(s0, s0 + len(tokens[s0 + 1 : s0 + 4])), lambda p: 1 / (least(p, last) - greatest(p - 3, 0) + 1))) AS held FROM win),
 n AS (SELECT doc_id, own, s0, held, term, count(*) AS n FROM (SELECT doc_id, own, s0, held, unnest(part) AS term FROM held) GROUP BY ALL), z AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id, s0)) AS size FROM n),
 near AS (SELECT doc_id, own, s0, held, topic_id, sum(n * x) / any_value(size) AS s FROM z JOIN unit USING (term) GROUP BY doc_id, own, s0, held, topic_id HAVING s >= 0.1),
 shares AS (SELECT doc_id, own, topic_id, sum(s * held) / sum(sum(s * held)) OVER (PARTITION BY doc_id) AS share FROM near GROUP BY doc_id, own, topic_id)"""

QUERIES = {f.__name__: f for f in (nearest_neighbours, reachability_forest, density_topics, merged_topics, topic_distributions, outliers_chained, topic_memberships)}
SQL = {
    "nearest_neighbours": """WITH e AS (SELECT min(vec_id) AS vec_id, embedding::DOUBLE[] AS v FROM embeddings GROUP BY embedding), d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
 SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour)::INT AS neighbour_rank, neighbour, round(d, 5) AS distance FROM d QUALIFY neighbour_rank <= 15""",
    "topic_distributions": f"WITH {WINDOWS} SELECT doc_id, topic_id, round(share, 5) AS share FROM shares",
    "outliers_chained": f"""WITH {WINDOWS}, t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM d WHERE topic_id < 0) GROUP BY ALL),
 size AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM t GROUP BY doc_id), by_terms AS (SELECT doc_id, topic_id FROM (SELECT doc_id, topic_id, sum(n * x) / any_value(size) AS s FROM t JOIN unit USING (term) JOIN size USING (doc_id) GROUP BY doc_id, topic_id) WHERE s > 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic_id) = 1),
 by_windows AS (SELECT doc_id, topic_id FROM shares WHERE own < 0 AND share >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, topic_id) = 1)
 SELECT d.doc_id, CASE WHEN d.topic_id >= 0 THEN d.topic_id ELSE coalesce(by_terms.topic_id, by_windows.topic_id, -1) END::INT AS topic_id FROM d LEFT JOIN by_terms USING (doc_id) LEFT JOIN by_windows USING (doc_id)""",
}
