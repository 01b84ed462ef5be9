"""Registered queries on tables of files, cuts of words and vectors learned from the corpus, with DuckDB counterparts where SQL has any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment, stats
from ..operators import cooccurrence, drift, evaluation, term_vectors
from ..operators.ranking import top_n
from ..sources.files import path_parts, read_tables
from ..sources.sinks import shared_folder, written
from . import base, ingest
from .queries_terms import POSTS, posts, rounded, scored

#: A small list of word parts with counts.
PARTS = {"th": 90, "the": 60, "he": 40, "an": 35, "and": 30, "in": 30, "ing": 25, "er": 25, "on": 22, "tion": 20, "ti": 9, "re": 18, "ed": 15, "en": 14, "ch": 12, "sch": 12, "ei": 8, "ein": 8, "ou": 10, "eau": 10, "que": 9, "de": 9, "nt": 8, "ntan": 2, "st": 10, "es": 9}


def tables_by_name(spark, sf) -> DataFrame:
    """Suppliers written as CSV files of two column orders and as Parquet with other columns, read back by name."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    place = f"{shared_folder(spark).rstrip('/')}/corpusloom-tables-{uuid.uuid4().hex}"
    part = lambda k: rows.where(F.col("id") % 3 == k)
    part(0).select("id", "name", "nation").write.option("header", True).csv(f"{place}/a")
    part(1).select("nation", "name", "id").write.option("header", True).csv(f"{place}/b")
    part(2).select(F.col("name").alias("title"), "id").write.parquet(f"{place}/c")
    found = read_tables(spark, f"{place}/*/part*", "origin")
    return found.select("id", "name", "nation", "title", F.regexp_extract("origin", "/([abc])/part", 1).alias("folder"))


def preprocess_posts(spark, sf) -> DataFrame:
    """Every document as a post: cleaned, two characters at least, cut at 2000."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("text", ingest.TEXT)
    return ingest.preprocess(docs).select("doc_id", F.length("text_raw").alias("raw_length"), F.length("cleaned_text").alias("length"), F.md5(F.col("cleaned_text").cast("binary")).alias("h"))


def path_metadata(spark, sf) -> DataFrame:
    """Keyword, year, month and day of paths made of the documents' columns; every third has no month, every fifth no numbers."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id")
    numbers = F.when(k % 5 == 0, F.lit("x/note")).when(k % 3 == 0, F.concat((2000 + k % 30).cast("string"), F.lit("/"), (1 + k % 28).cast("string"))).otherwise(F.concat_ws("/", (2000 + k % 30).cast("string"), (1 + k % 12).cast("string"), (1 + k % 28).cast("string")))
    found = path_parts(F.concat(F.lit("raw/"), F.col("source"), F.lit("/CSV/"), F.col("lang"), F.lit("/"), numbers, F.lit(".csv")))
    return docs.select("doc_id", found.alias("p")).select("doc_id", "p.*")


def month_and_period_limits(spark, sf) -> DataFrame:
    """Orders by year, up to the end of May 1996 and in periods up to 1995Q3."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("publish_time"), stats.period(F.col("o_orderdate"), "quarter").alias("period_label"))
    both = base.before_month_end(rows, "1996-05").withColumn("kind", F.lit("month")).unionByName(base.up_to_period(rows, "1995Q3").withColumn("kind", F.lit("period")))
    return both.groupBy("kind", "period_label").agg(F.count("*").alias("n"))


def two_label_frame(spark, sf) -> DataFrame:
    """Texts with two labels, one of them written in words; rows without either are left out."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    words = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("quality") == 1, "1").otherwise("0")
    rows = docs.join(marks, "doc_id").select("doc_id", F.col("text").alias("body"), words.alias("broad_raw"), F.col("toxic").alias("strict_raw"))
    return evaluation.labelled_frame(rows, "body", {"broad": "broad_raw", "strict": "strict_raw"}).select("doc_id", F.length("text").alias("length"), "broad", "strict")


def prediction_columns(spark, sf) -> DataFrame:
    """Prediction columns from a probability that the length of a document gives; every ninth document has none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") % 100 / 100.0).alias("p"))
    return rounded(evaluation.predictions(rows, "p", 0.3, "m").drop("p", "pred_label_text"))


def dictionary_segments(spark, sf) -> DataFrame:
    """Every distinct run of letters in the documents, cut into parts of a small list."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("run")).groupBy(F.lower("run").alias("run")).agg(F.count("*").alias("n"))
    words = spark.createDataFrame(list(PARTS.items()), "word string, count long")
    return segment.with_segments(runs, "run", words, "parts", "[a-z]+", "", False).select("run", "n", F.array_join("parts", "|").alias("parts"))


def positive_pmi(spark, sf) -> DataFrame:
    """Pairs of terms within four words of each other, above chance."""
    return rounded(term_vectors.positive_pmi(term_vectors.near_pairs(posts(spark, sf), least=20), 20), 5)


def _vectors(spark, sf) -> DataFrame:
    return term_vectors.learned_vectors(posts(spark, sf), dims=16, least=10)


def _learned_neighbours(spark, sf) -> DataFrame:
    """Nearest terms of each keyword and period: a keyword's vector is the mean of those of its ten best terms in all periods."""
    terms, vectors = written(scored(spark, sf)), _vectors(spark, sf)
    best = top_n(terms.where("period_label = 'ALL'"), ["keyword"], [F.col("term_rank").asc()], 10, "k").select("keyword", "term").join(vectors, "term")
    own = best.select("keyword", F.posexplode("vector").alias("i", "x")).groupBy("keyword", "i").agg(F.avg("x").alias("m"))
    own = own.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))  # one row a keyword
    named = own.select(F.concat(F.lit("="), "keyword").alias("term"), "vector").unionByName(vectors)
    return cooccurrence.semantic_neighbors(terms.withColumn("keyword", F.concat(F.lit("="), "keyword")), named, 50, 20).withColumn("keyword", F.substring("keyword", 2, 100))


def learned_neighbours(spark, sf) -> DataFrame:
    return rounded(_learned_neighbours(spark, sf), 4)


def drift_learned_neighbours(spark, sf) -> DataFrame:
    """Drift of the neighbours that keywords have by vectors learned from the corpus."""
    rows = written(_learned_neighbours(spark, sf)).where("period_label <> 'ALL'").select("keyword", "period_label", "neighbor_term", "embedding_similarity", "neighbor_rank")
    return rounded(drift.ranked_term_drift(rows, "neighbor_term", "embedding_similarity", "neighbor_rank"), 4)


def text_vector_lengths(spark, sf) -> DataFrame:
    """Documents by the mean of their terms' vectors."""
    found = term_vectors.text_vectors(posts(spark, sf), _vectors(spark, sf))
    return rounded(found.select("doc_id", F.size("vector").alias("dims"), F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("length")), 4)


def _price(count: int) -> int:
    return segment.cost(count, sum(PARTS.values()))


QUERIES = {f.__name__: f for f in (tables_by_name, preprocess_posts, path_metadata, month_and_period_limits, two_label_frame, prediction_columns, dictionary_segments, positive_pmi, learned_neighbours, drift_learned_neighbours, text_vector_lengths)}
SQL = {
    "preprocess_posts": r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS raw, trim(regexp_replace(regexp_replace(regexp_replace(trim(text, E' \n\t\r'), 'https?://\S+', '', 'gi'), '全文\s*$', ''), '\s+', ' ', 'g')) AS cleaned FROM documents)
 SELECT doc_id, length(raw)::INT AS raw_length, length(substring(cleaned, 1, 2000))::INT AS length, md5(substring(cleaned, 1, 2000)) AS h FROM c WHERE length(cleaned) >= 2""",
    "month_and_period_limits": "WITH r AS (SELECT o_orderdate AS d, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period_label FROM orders) SELECT kind, period_label, count(*) AS n FROM (SELECT 'month' AS kind, period_label FROM r WHERE d < '1996-06-01' UNION ALL SELECT 'period', period_label FROM r WHERE period_label <= '1995Q3') GROUP BY ALL",
    "two_label_frame": "SELECT doc_id, length(trim(text))::INT AS length, quality::INT AS broad, toxic::INT AS strict FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0 AND trim(text, E' \\n\\t\\r') <> ''",
    "prediction_columns": "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars % 100 / 100.0::DOUBLE END AS p FROM documents) SELECT doc_id, CASE WHEN p >= 0.3 THEN 1 WHEN p IS NOT NULL THEN 0 END::INT AS pred_label, round(p, 6) AS pred_prob_1, round(1 - p, 6) AS pred_prob_0, round(greatest(p, 1 - p), 6) AS pred_confidence, 'm' AS model_dir FROM r",
    "path_metadata": "SELECT doc_id, lang AS keyword, CASE WHEN doc_id % 5 = 0 THEN 9999 ELSE 2000 + doc_id % 30 END::INT AS year, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 99 ELSE 1 + doc_id % 12 END::INT AS month, CASE WHEN doc_id % 5 = 0 THEN 99 ELSE 1 + doc_id % 28 END::INT AS day FROM documents",
    "tables_by_name": "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS name, CASE WHEN s_suppkey % 3 < 2 THEN s_nationkey::VARCHAR END AS nation, CASE WHEN s_suppkey % 3 = 2 THEN s_name END AS title, substring('abc', (s_suppkey % 3 + 1)::INT, 1) AS folder FROM supplier",
    "dictionary_segments": f"""WITH RECURSIVE runs AS (SELECT lower(run) AS run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS run FROM documents) GROUP BY lower(run)),
 d AS MATERIALIZED (SELECT MAP {{{', '.join(f"'{w}': {_price(n)}" for w, n in PARTS.items())}}} AS price),
 cuts AS (SELECT run, n, length(run) AS i, [0::BIGINT] AS costs, [''] AS paths FROM runs
 UNION ALL SELECT run, n, i - 1, list_prepend(best.c, costs), list_prepend(substr(run, i, -best.l) || CASE WHEN paths[-best.l] = '' THEN '' ELSE '|' || paths[-best.l] END, paths)
 FROM (SELECT cuts.*, list_sort(list_filter(list_transform(range(1, least({max(map(len, PARTS))}, length(run) - i + 1) + 1), lambda l: {{'c': coalesce(price[substr(run, i, l)], CASE WHEN l = 1 THEN {_price(1)} END) + costs[l], 'l': -l}}), lambda o: o.c IS NOT NULL))[1] AS best FROM cuts, d WHERE i >= 1))
 SELECT run, n, paths[1] AS parts FROM cuts WHERE i = 0""",
    "positive_pmi": f"""WITH {POSTS}, w AS (SELECT tokens, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS k FROM posts), p AS (SELECT term, unnest(tokens[k + 1 : k + 4]) AS other FROM w),
 met AS (SELECT term, other, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT other, term FROM p) GROUP BY ALL HAVING count(*) >= 20), c AS (SELECT term, sum(n)::DOUBLE ** 0.75 AS c FROM met GROUP BY term), t AS (SELECT (SELECT sum(n) FROM met) AS whole, (SELECT sum(c) FROM c) AS mass)
 SELECT term, other, round(weight, 5) AS weight FROM (SELECT b.term, other, ln(n / whole / (x.c / mass * y.c / mass)) AS weight FROM met b JOIN c x ON x.term = b.term JOIN c y ON y.term = other, t) WHERE weight > 0""",
}
