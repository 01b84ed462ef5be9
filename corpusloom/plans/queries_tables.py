"""Registered queries on tables: cleaning, deduplication, shares, drift of shares, samples, evaluation, macro topics, merges.

Orders stand for posts with a date: status is the keyword, priority the topic, the customer's nation the region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import dedup, drift, evaluation, macro, merge, sampling, shares
from ..operators.ranking import first_of, top_n
from . import base
from .queries_terms import JS, rounded, scored_sql


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_posts(spark, sf, granularity="month"):
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("keyword"), stats.period(F.col("o_orderdate"), granularity).alias("period_label"), F.col("n_name").alias("region"), F.col("o_orderpriority").alias("topic_id"), F.col("o_orderpriority").alias("topic_label"), "o_totalprice")


ORDERS = "p AS (SELECT o_orderkey AS id, o_orderstatus AS keyword, {label} AS period_label, n_name AS region, o_orderpriority AS topic_id, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
MONTH = ORDERS.format(label="strftime(o_orderdate, '%Y-%m')")
YEAR = ORDERS.format(label="strftime(o_orderdate, '%Y')")


# filters, projections, cleaning


def filter_non_blank_id(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.where(~text.is_blank("source")).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def preprocess_clean(spark, sf):
    """Every document through the cleaner: how long it is then, and its hash."""
    docs = read(spark, sf, "documents").select("doc_id", F.explode(F.array(text.emoji_placeholder(text.clean_post("text")))).alias("cleaned"))  # worked out once, for filter and hash
    return docs.select("doc_id", F.length("cleaned").alias("n"), F.md5(F.col("cleaned").cast("binary")).alias("h")).where("n >= 2")


def text_previews(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", text.preview("text").alias("preview"), text.truncate("text").alias("short"), text.shorten("text", 60).alias("ends"))


def length_bins(spark, sf):
    return read(spark, sf, "benchmark").unionByName(read(spark, sf, "conversations").select(F.col("conv_id").alias("item_id"), "text")).groupBy(stats.length_bin(F.length("text")).alias("len_bin")).agg(F.count("*").alias("n"))


def period_month_quarter_year(spark, sf):
    o = base.with_time(read(spark, sf, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "t")
    return o.groupBy("year", "year_month", "year_quarter", "year_only").agg(F.count("*").alias("n"))


def engagement_parse(spark, sf):
    e = read(spark, sf, "events").withColumn("raw", F.concat(F.format_number(F.floor("value"), 0), F.when(F.col("event_id") % 3 == 0, "万").otherwise("")))
    return e.groupBy("event_type").agg(F.sum(text.engagement("raw")).alias("total"), F.sum(shortlist_score(text.engagement("raw"))).alias("score"))


def shortlist_score(c):
    from ..operators.shortlist import engagement_score

    return engagement_score(c, c % 7, c % 3)


def label_normalize(spark, sf):
    marks = read(spark, sf, "labels").withColumn("raw", F.when(F.col("toxic") == 1, "2").when(F.col("quality") == 1, " Yes ").otherwise("无关"))
    return evaluation.normalised_labels(marks, "raw").groupBy("label_raw", "label", "label_text").agg(F.count("*").alias("n"))


def analysis_base_filter(spark, sf):
    o = order_posts(spark, sf).select(F.col("id").cast("string"), F.concat(F.lit("#"), "keyword", F.lit("# ")).alias("keyword"), F.concat(F.lit("IP属地："), "region").alias("ip"), F.concat("period_label", F.lit("-01 10:00")).alias("created_at"), F.col("topic_id").alias("text"), (F.col("id") % 3 / 2 + 0.6).alias("pred_label"), (F.col("id") % 100 / 100).alias("pred_prob_1"))
    out = base.analysis_base(o, ["F", "O"], True, 0.25)
    return out.select("id", "keyword_normalized", "ip_normalized", "ip_missing", "year_quarter")


def base_metadata_counters(spark, sf):
    return rounded(shares.base_counters(read(spark, sf, "documents").withColumn("region", F.when(F.col("n_chars") % 5 == 0, "UNKNOWN_IP").otherwise(F.col("source")))))


def keyword_region_normalizers(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit(" #"), "lang", F.lit("%23 ")).alias("k"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("IP属地: "), "source")).otherwise("未知").alias("r"))
    return d.groupBy(text.canonical_keyword("k", ["en", "de"]).alias("keyword"), text.normalize_region("r").alias("region")).agg(F.count("*").alias("n"))


# deduplication, joins against state


def id_dedup_keep_first(spark, sf):
    c = read(spark, sf, "conversations").withColumn("id", F.col("conv_id").cast("string"))
    seen = c.where("conv_id % 10 = 0").select(text.text_hash("id").alias("h")).distinct()
    new, _, _ = dedup.dedup_by_id(c, seen, ["turn", "role", "text"])
    return new.select("conv_id", "turn", "role", "h")


def id_dedup_counters(spark, sf):
    c = read(spark, sf, "conversations").withColumn("id", F.when(F.col("conv_id") % 7 == 0, " ").otherwise(F.col("conv_id").cast("string")))
    seen = c.where("conv_id % 10 = 0").select(text.text_hash("id").alias("h")).distinct()
    return dedup.dedup_by_id(c, seen, ["turn", "role", "text"])[1]


def text_dedup_md5(spark, sf):
    d = read(spark, sf, "documents")
    return dedup.dedup_by_text(d, spark.createDataFrame([], "h string"), ["doc_id"], "text").select("doc_id", "h")


def anti_join_seen_state(spark, sf):
    d = read(spark, sf, "documents").withColumn("h", text.text_hash("text"))
    return dedup.without_seen(d, d.where("source = 'src0'").select("h"), "h").select("doc_id", "source")


def overlap_signature_antijoin(spark, sf):
    d = read(spark, sf, "documents").select("text", "lang", "doc_id")
    return dedup.without_overlap(d.select("text", "lang", F.col("doc_id").alias("id")), d.where("doc_id % 4 = 0").select("text", "lang")).select("id", "lang")


def manifest_delta(spark, sf):
    now = read(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.col("page_id").alias("mtime_ns"), "page_id")
    old = now.withColumn("size", F.col("size") + F.when(F.col("page_id") % 6 == 0, 1).otherwise(0))
    return dedup.changed_files(now, old.where("page_id % 5 <> 0")).select("page_id", "size")


def resume_results(spark, sf):
    d = read(spark, sf, "documents").select("text", "lang", "source")
    done = d.where("source <> 'src1'").withColumn("answer", F.concat("lang", F.lit("-"), F.length("text").cast("string")))
    return dedup.resumed(d, done, ["answer"]).groupBy("source", "answer").agg(F.count("*").alias("n"))


# shares


def _share(groups):
    def run(spark, sf):
        return rounded(shares.topic_share(order_posts(spark, sf), groups, label=None))

    return run


def _share_sql(groups):
    g = ", ".join(groups)
    return f"WITH {MONTH} SELECT {g}, topic_id, count(*) AS doc_count, round(count(*) / sum(count(*)) OVER (PARTITION BY {g}), 6) AS doc_share FROM p GROUP BY {g}, topic_id"


def share_family(spark, sf):
    return rounded(shares.share_family(order_posts(spark, sf, "year")))


def topic_overview(spark, sf):
    return rounded(shares.topic_overview(order_posts(spark, sf), outlier="5-LOW"))


def topic_headlines(spark, sf):
    return rounded(shares.topic_headlines(shares.topic_share(order_posts(spark, sf), ["region"], label=None), "region"))


def semantic_headlines(spark, sf):
    from .queries_terms import scored

    return rounded(shares.semantic_headlines(scored(spark, sf)).select("keyword", "period_label", "term", "pmi", "headline_rank"))


def drift_topic_share(spark, sf):
    return rounded(drift.share_drift(shares.topic_share(order_posts(spark, sf), ["period_label"], label=None)))


def drift_topic_share_by_keyword(spark, sf):
    return rounded(drift.share_drift(shares.topic_share(order_posts(spark, sf), ["keyword", "period_label"], label=None), ["keyword"]))


def drift_topic_share_by_region(spark, sf):
    return rounded(drift.share_drift(shares.topic_share(order_posts(spark, sf, "year"), ["region", "period_label"], label=None), ["region"]))


def drift_topic_share_by_keyword_region(spark, sf):
    return rounded(drift.share_drift(shares.topic_share(order_posts(spark, sf, "year"), ["keyword", "region", "period_label"], label=None), ["keyword", "region"]))


def drift_share_change(spark, sf):
    return rounded(drift.share_change(shares.topic_share(order_posts(spark, sf), ["keyword", "period_label"], label=None), ["keyword"]))


def drift_watchlist(spark, sf):
    o = order_posts(spark, sf, "year")
    by = lambda g: drift.share_drift(shares.topic_share(o, [*g, "period_label"], label=None), g)
    return rounded(drift.watch_list({"keyword": (by(["keyword"]), ["keyword"], "topic_js_divergence"), "region": (by(["region"]), ["region"], "topic_js_divergence"), "overall": (by([]), [], "topic_js_divergence")}), 5)


def _drift_sql(groups: list[str], cte: str, cols: str, tail: str) -> str:
    g = "".join(f"{c}, " for c in groups)
    on = "".join(f" AND x.{c} = r.{c}" for c in groups)
    part = f"PARTITION BY {', '.join(groups)} " if groups else ""
    return f"""{cte}, s AS (SELECT {g}period_label, topic_id, count(*) / sum(count(*)) OVER (PARTITION BY {g}period_label) AS share FROM p GROUP BY {g}period_label, topic_id),
 q AS (SELECT {g}period_label AS current_period, lag(period_label) OVER ({part}ORDER BY period_label) AS previous_period FROM (SELECT DISTINCT {g}period_label FROM s)),
 r AS (SELECT * FROM q WHERE previous_period IS NOT NULL),
 u AS (SELECT {''.join(f'r.{c}, ' for c in groups)}previous_period, current_period, topic_id, sum(CASE WHEN period_label = previous_period THEN share ELSE 0 END) AS p, sum(CASE WHEN period_label = current_period THEN share ELSE 0 END) AS q
   FROM r JOIN s x ON (x.period_label = previous_period OR x.period_label = current_period){on} GROUP BY ALL),
 d AS (SELECT {g}previous_period, current_period, {JS} AS js, count(*) AS topic_count FROM u GROUP BY ALL) SELECT {g}{cols} FROM {tail}"""


DRIFTED = "previous_period, current_period, round(js, 6) AS topic_js_divergence, topic_count"


# samples and splits


def _strata(spark, sf):
    o = order_posts(spark, sf, "year")
    return o.withColumn("stratum_id", sampling.stratum(F.col("period_label"), F.col("keyword"), F.col("topic_id")))


STRATA = YEAR + ", s AS (SELECT *, period_label || '|' || keyword || '|' || CASE WHEN length(topic_id) <= 20 THEN '<=20' ELSE '21-60' END AS stratum_id FROM p)"


def strata_counts(spark, sf):
    return sampling.strata_counts(_strata(spark, sf))


def allocation_hamilton(spark, sf):
    return sampling.hamilton(sampling.strata_counts(_strata(spark, sf)), 500)


def _takes(spark, sf):
    counts = {r[0]: r[1] for r in sampling.strata_counts(_strata(spark, sf)).collect()}
    return sampling.allocate(counts, min(500, sum(counts.values())))


def stratified_sample_exact(spark, sf):
    return sampling.sample(_strata(spark, sf), _takes(spark, sf), "id").select("stratum_id", "id")


HAMILTON = STRATA + """, c AS (SELECT stratum_id, count(*) AS population_count FROM s GROUP BY ALL), x AS (SELECT *, population_count / sum(population_count) OVER () * 500 AS e FROM c),
 h AS (SELECT stratum_id, population_count, floor(e)::BIGINT + (row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, stratum_id) <= 500 - sum(floor(e)) OVER ())::BIGINT AS sample_count FROM x)"""


def split_three_way(spark, sf):
    marks = read(spark, sf, "labels").dropDuplicates(["doc_id"])
    return sampling.split(marks, "doc_id", "quality").select("doc_id", "quality", "split")


def assembled_split(spark, sf):
    """Every seventh label is given as validation and taken out of the pool, which is split by quality."""
    marks = read(spark, sf, "labels").dropDuplicates(["doc_id"])
    return sampling.assembled_split(marks, {"val": marks.where("doc_id % 7 = 0")}, "doc_id", ["quality"])[0].select("doc_id", "quality", "split")


def predefined_split_alias(spark, sf):
    marks = read(spark, sf, "labels").withColumn("part", F.element_at(F.array(*map(F.lit, ("Training", "dev", " TEST ", "train"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return sampling.split_manifest(sampling.predefined_split(marks, "part"), "quality")


def row_ids(spark, sf):
    return sampling.row_ids(read(spark, sf, "labels"), ["doc_id", "quality", "toxic"]).agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("different"))


# evaluation


def _judged(spark, sf, threshold=1500.0):
    d, marks = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = marks.join(d, "doc_id").select("doc_id", "source", "text", F.col("quality").alias("gold_label"), (F.col("n_chars") / (F.col("n_chars") + threshold)).alias("p"))
    return evaluation.judged(evaluation.predictions(rows, "p"))


JUDGED = """j AS (SELECT l.doc_id, source, quality AS gold, n_chars / (n_chars + {t}) AS p, CASE WHEN n_chars / (n_chars + {t}) >= 0.5 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 e{n} AS (SELECT *, gold <> pred AS is_error, CASE WHEN gold = 1 AND pred = 0 THEN 'FN' WHEN gold = 0 AND pred = 1 THEN 'FP' ELSE '' END AS error_type, greatest(p, 1 - p) AS conf FROM j)"""
JUDGE = JUDGED.format(t="1500.0", n="")


def confusion_metrics(spark, sf):
    return rounded(evaluation.metrics(_judged(spark, sf), ["source"]))


def error_summary(spark, sf):
    return rounded(evaluation.error_summary(_judged(spark, sf)))


def ranked_errors(spark, sf):
    """Top-k report: its limit is the feature."""
    return rounded(evaluation.ranked_errors(_judged(spark, sf), 50, "FN").select("doc_id", "pred_confidence"))


def side_by_side_buckets(spark, sf):
    a, b = _judged(spark, sf), _judged(spark, sf, 700.0)
    cols = ["doc_id", "pred_label", "is_error"]
    out = evaluation.side_by_side(a.select("doc_id", "source"), a.select(*cols), b.select(*cols), "doc_id")
    return out.groupBy("error_bucket").agg(F.count("*").alias("n"))


def label_diagnosis(spark, sf):
    rows = _judged(spark, sf).withColumn("label_standard", F.col("source"))
    m = evaluation.metrics(rows, ["label_standard"])
    return rounded(evaluation.diagnosis(m, m, rows).select("label_standard", "f1", "dominant_error", "dominant_error_count", "focus", "suggested_file", "f1_gap"))


def metric_rows(spark, sf):
    return rounded(evaluation.metric_rows(evaluation.metrics(_judged(spark, sf), ["source"]), ["source"]))


# macro topics

MACRO = [("urgent things", "keep", ["urgent", "high"]), ("plain things", "weak", ["medium"])]


def _mapped(spark, sf):
    topics = order_posts(spark, sf).groupBy("topic_id").agg(F.count("*").alias("doc_count")).withColumn("top_terms", F.lower("topic_id"))
    return macro.assign_macro(topics, {}, MACRO, [("low things", "omit", ["low"])], ("other", "weak"), F.col("top_terms"))


MAPPED = "m AS (SELECT topic_id, count(*) AS doc_count, lower(topic_id) AS top_terms, CASE WHEN regexp_matches(lower(topic_id), 'urgent|high') THEN 'urgent things' WHEN lower(topic_id) LIKE '%medium%' THEN 'plain things' WHEN lower(topic_id) LIKE '%low%' THEN 'low things' ELSE 'other' END AS macro_topic, CASE WHEN regexp_matches(lower(topic_id), 'urgent|high') THEN 'keep' WHEN lower(topic_id) LIKE '%low%' THEN 'omit' ELSE 'weak' END AS report_action FROM p GROUP BY topic_id)"


def macro_mapping_rules(spark, sf):
    return _mapped(spark, sf).select("topic_id", "doc_count", "macro_topic", "report_action", "merge_source")


def _macro_shares(spark, sf):
    return macro.macro_shares(shares.topic_share(order_posts(spark, sf, "year"), ["period_label"], label=None), _mapped(spark, sf), ["1995"])


MACRO_SHARES = MAPPED + ", ms AS (SELECT macro_topic, period_label, count(*) AS doc_count, count(*) / sum(count(*)) OVER (PARTITION BY period_label) AS doc_share FROM p JOIN m USING (topic_id) WHERE period_label <> '1995' GROUP BY macro_topic, period_label)"


def macro_share_excl_periods(spark, sf):
    return rounded(_macro_shares(spark, sf))


def macro_overview(spark, sf):
    return rounded(macro.macro_overview(_mapped(spark, sf), _macro_shares(spark, sf)))


def action_share(spark, sf):
    return rounded(macro.action_share(shares.topic_share(order_posts(spark, sf, "year"), ["period_label"], label=None), _mapped(spark, sf)))


def macro_pivot(spark, sf):
    return rounded(macro.macro_matrix(_macro_shares(spark, sf), ["1996", "1997", "1998"]))


def metric_cards(spark, sf):
    return rounded(macro.metric_cards(_mapped(spark, sf)))


def sweep_gate(spark, sf):
    topics = read(spark, sf, "embeddings").groupBy((F.col("label") - 1).alias("topic_id")).agg(F.count("*").alias("doc_count"))
    return rounded(macro.sweep_gate(topics))


def _annotations(spark, sf):
    marks = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    one = marks.select(F.lit(0).alias("tab"), F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("keyword"), F.col("source").alias("cleaned_text"), F.when(F.col("doc_id") % 3 > 0, F.col("quality").cast("string")).alias("broad"), F.col("toxic").cast("string").alias("strict"))
    two = marks.select(F.lit(1), "doc_id", F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.lit("x"), F.lit("2.0"), F.when(F.col("doc_id") % 5 == 0, "1"))
    return one.union(two)


def annotation_merge(spark, sf):
    return merge.merge_annotations(_annotations(spark, sf), ["tab", "row"])[0]


def annotation_conflicts(spark, sf):
    return merge.merge_annotations(_annotations(spark, sf), ["tab", "row"])[1].select("merge_key", "field", "kept", "value")


def label_orders(spark, sf):
    """Periods and regions in the order of reports, unknown ones last."""
    docs = read(spark, sf, "documents").withColumn("p", F.when(F.col("doc_id") % 5 == 0, "NA").otherwise(F.col("source"))).withColumn("r", F.when(F.col("doc_id") % 7 == 0, "UNKNOWN_IP").when(F.col("doc_id") % 7 == 1, "").otherwise(F.concat(F.lit("Z"), "lang")))
    orders = [shares.period_order(docs, "p").select(F.lit("period").alias("kind"), F.col("p").alias("label"), "ord"), shares.region_order(docs, "r").select(F.lit("region").alias("kind"), F.col("r").alias("label"), "ord")]
    return orders[0].unionByName(orders[1])


def value_counts(spark, sf):
    return shares.value_counts(read(spark, sf, "events"), "event_type")


def max_drift_rows(spark, sf):
    d = drift.share_drift(shares.topic_share(order_posts(spark, sf), ["keyword", "period_label"], label=None), ["keyword"])
    return rounded(first_of(d, ["keyword"], [F.round("topic_js_divergence", 9).desc(), F.col("current_period").asc()]))


def top_events(spark, sf):
    """Largest events of each type: a top-k report."""
    return top_n(read(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("value").desc_nulls_last(), F.col("event_id").asc()], 10)


def dataset_fingerprint(spark, sf):
    return dedup.fingerprint(read(spark, sf, "documents"))


_SHARES = {"share_by_period": ["period_label"], "share_by_period_keyword": ["keyword", "period_label"], "share_by_region": ["region"], "share_by_period_region": ["period_label", "region"], "share_by_period_region_keyword": ["keyword", "period_label", "region"]}

QUERIES = {f.__name__: f for f in (
    filter_non_blank_id, preprocess_clean, text_previews, length_bins, period_month_quarter_year, engagement_parse, label_normalize, analysis_base_filter, base_metadata_counters, keyword_region_normalizers,
    id_dedup_keep_first, id_dedup_counters, text_dedup_md5, anti_join_seen_state, overlap_signature_antijoin, manifest_delta, resume_results, share_family, topic_overview, topic_headlines, semantic_headlines,
    drift_topic_share, drift_topic_share_by_keyword, drift_topic_share_by_region, drift_topic_share_by_keyword_region, drift_share_change, drift_watchlist, strata_counts, allocation_hamilton, stratified_sample_exact, split_three_way, assembled_split,
    predefined_split_alias, row_ids, confusion_metrics, error_summary, ranked_errors, side_by_side_buckets, label_diagnosis, metric_rows, macro_mapping_rules, macro_share_excl_periods, macro_overview, action_share, macro_pivot,
    metric_cards, sweep_gate, annotation_merge, annotation_conflicts, label_orders, value_counts, max_drift_rows, top_events, dataset_fingerprint,
)} | {name: _share(groups) for name, groups in _SHARES.items()}

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(text, E' \n\t\r'), 'https?://\S+', '', 'gi'), '全文\s*$', ''), '\s+', ' ', 'g'))"
METRICS = "count(*) AS n, count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE gold = 0 AND pred = 0) AS tn"
RATIOS = "coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
MET = f"{JUDGE}, c AS (SELECT source, {METRICS} FROM e GROUP BY source), m AS (SELECT *, {RATIOS} FROM c)"

SQL = {
    "filter_non_blank_id": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE trim(source) <> '' GROUP BY source",
    "preprocess_clean": f"WITH c AS (SELECT doc_id, {CLEAN} AS cleaned FROM documents) SELECT doc_id, length(cleaned)::INT AS n, md5(cleaned) AS h FROM c WHERE length(cleaned) >= 2",
    "text_previews": r"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a, trim(replace(text, chr(10), ' ')) AS b FROM documents)
 SELECT doc_id, CASE WHEN length(a) > 120 THEN substring(a, 1, 120) || '...' ELSE a END AS preview, CASE WHEN length(b) > 140 THEN substring(b, 1, 137) || '...' ELSE b END AS short, CASE WHEN length(text) > 60 THEN substring(text, 1, 30) || ' … ' || right(text, 30) ELSE text END AS ends FROM c""",
    "length_bins": "SELECT CASE WHEN length(text) <= 20 THEN '<=20' WHEN length(text) <= 60 THEN '21-60' WHEN length(text) <= 140 THEN '61-140' ELSE '>140' END AS len_bin, count(*) AS n FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) GROUP BY 1",
    "period_month_quarter_year": "SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS year_month, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS year_quarter, strftime(o_orderdate, '%Y') AS year_only, count(*) AS n FROM orders GROUP BY ALL",
    "engagement_parse": "WITH e AS (SELECT event_type, floor(value)::BIGINT * CASE WHEN event_id % 3 = 0 THEN 10000 ELSE 1 END AS v FROM events) SELECT event_type, sum(v)::BIGINT AS total, sum(v + 2 * (v % 7) + 3 * (v % 3))::BIGINT AS score FROM e GROUP BY event_type",
    "label_normalize": "WITH r AS (SELECT CASE WHEN toxic = 1 THEN '2' WHEN quality = 1 THEN ' Yes ' ELSE '无关' END AS label_raw FROM labels) SELECT label_raw, CASE WHEN label_raw = ' Yes ' THEN 1 ELSE 0 END::INT AS label, CASE WHEN label_raw = ' Yes ' THEN '相关' ELSE '无关' END AS label_text, count(*) AS n FROM r GROUP BY ALL",
    "analysis_base_filter": f"WITH {ORDERS.format(label=chr(34) + 'o_orderdate' + chr(34))} SELECT id::VARCHAR AS id, keyword AS keyword_normalized, region AS ip_normalized, false AS ip_missing, strftime(period_label, '%Y') || 'Q' || quarter(period_label) AS year_quarter FROM p WHERE keyword IN ('F', 'O') AND floor(id % 3 / 2 + 0.6) = 1 AND id % 100 / 100 >= 0.25",
    "base_metadata_counters": "SELECT count(*) AS row_count, round(avg(CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END), 6) AS missing_rate, count(DISTINCT CASE WHEN n_chars % 5 <> 0 THEN source END) AS region_count FROM documents",
    "keyword_region_normalizers": "SELECT lang AS keyword, CASE WHEN doc_id % 2 = 0 THEN source END AS region, count(*) AS n FROM documents GROUP BY ALL",
    "id_dedup_keep_first": "SELECT conv_id, turn, role, md5(conv_id::VARCHAR) AS h FROM conversations WHERE conv_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1",
    "id_dedup_counters": "WITH g AS (SELECT count(*) AS n, count(*) FILTER (WHERE conv_id % 7 = 0) AS blank, count(DISTINCT conv_id) FILTER (WHERE conv_id % 7 <> 0) AS first, count(DISTINCT conv_id) FILTER (WHERE conv_id % 7 <> 0 AND conv_id % 10 <> 0) AS new FROM conversations) SELECT n AS incoming_rows, blank AS missing_id_rows, n - blank - first AS batch_dedup_removed, first - new AS existing_dedup_removed, new AS appended_rows FROM g",
    "text_dedup_md5": "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text",
    "anti_join_seen_state": "SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0')",
    "overlap_signature_antijoin": "SELECT doc_id AS id, lang FROM documents WHERE (text, lang) NOT IN (SELECT (text, lang) FROM documents WHERE doc_id % 4 = 0)",
    "manifest_delta": "SELECT page_id, length(html) AS size FROM pages p WHERE page_id % 6 = 0 OR page_id % 5 = 0",
    "resume_results": "SELECT source, CASE WHEN source <> 'src1' THEN lang || '-' || length(text) END AS answer, count(*) AS n FROM documents GROUP BY ALL",
    "share_family": f"""WITH {YEAR}, g AS (SELECT CASE GROUPING_ID(keyword, period_label, region) WHEN 5 THEN 'period' WHEN 1 THEN 'keyword_period' WHEN 6 THEN 'region' WHEN 4 THEN 'period_region' ELSE 'keyword_period_region' END AS level, keyword, period_label, region, topic_id, count(*) AS doc_count FROM p
 GROUP BY GROUPING SETS ((period_label, topic_id), (keyword, period_label, topic_id), (region, topic_id), (period_label, region, topic_id), (keyword, period_label, region, topic_id))) SELECT *, round(doc_count / sum(doc_count) OVER (PARTITION BY level, keyword, period_label, region), 6) AS doc_share FROM g""",
    "topic_overview": f"""WITH {MONTH}, t AS (SELECT topic_id, count(*) AS doc_count, round(count(*) / sum(count(*)) OVER (), 6) AS share_of_all, CASE WHEN topic_id = '5-LOW' THEN 0 ELSE round(count(*) / sum(CASE WHEN topic_id <> '5-LOW' THEN count(*) ELSE 0 END) OVER (), 6) END::DOUBLE AS share_of_clustered FROM p GROUP BY topic_id),
 s AS (SELECT period_label, topic_id, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY period_label) AS share FROM p GROUP BY period_label, topic_id), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, share DESC, period_label) = 1),
 w AS (SELECT topic_id, keyword, count(*) AS n FROM p GROUP BY topic_id, keyword QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, keyword) = 1)
 SELECT t.*, period_label AS peak_period, k.n AS peak_doc_count, round(k.share, 6) AS peak_doc_share, keyword AS dominant_keyword, w.n AS dominant_keyword_docs FROM t JOIN k USING (topic_id) JOIN w USING (topic_id)""",
    "topic_headlines": f"WITH {MONTH}, s AS (SELECT region, topic_id, count(*) AS doc_count, count(*) / sum(count(*)) OVER (PARTITION BY region) AS share FROM p GROUP BY region, topic_id) SELECT region, topic_id, doc_count, round(share, 6) AS doc_share FROM s QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY share DESC, doc_count DESC, region) = 1",
    "drift_topic_share": _drift_sql([], f"WITH {MONTH}", DRIFTED, "d"),
    "drift_topic_share_by_keyword": _drift_sql(["keyword"], f"WITH {MONTH}", DRIFTED, "d"),
    "drift_topic_share_by_region": _drift_sql(["region"], f"WITH {YEAR}", DRIFTED, "d"),
    "drift_topic_share_by_keyword_region": _drift_sql(["keyword", "region"], f"WITH {YEAR}", DRIFTED, "d"),
    "drift_share_change": _drift_sql(["keyword"], f"WITH {MONTH}", "previous_period, current_period, topic_id, round(p, 6) AS previous_share, round(q, 6) AS current_share, round(q - p, 6) AS share_delta", "u"),
    "max_drift_rows": _drift_sql(["keyword"], f"WITH {MONTH}", DRIFTED, "d QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY round(js, 9) DESC, current_period) = 1"),
    "strata_counts": f"WITH {STRATA} SELECT stratum_id, count(*) AS population_count FROM s GROUP BY ALL",
    "allocation_hamilton": f"WITH {HAMILTON} SELECT * FROM h",
    "stratified_sample_exact": f"WITH {HAMILTON} SELECT stratum_id, id FROM s JOIN h USING (stratum_id) QUALIFY row_number() OVER (PARTITION BY stratum_id ORDER BY md5(id::VARCHAR || '|42'), id) <= max(sample_count) OVER (PARTITION BY stratum_id)",
    "assembled_split": "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE doc_id % 7 <> 0) SELECT doc_id, quality, CASE WHEN k <= round(n * 0.1) THEN 'test' WHEN k <= round(n * 0.1) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r UNION ALL SELECT doc_id, quality, 'val' FROM labels WHERE doc_id % 7 = 0",
    "split_three_way": "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN k <= round(n * 0.1) THEN 'test' WHEN k <= round(n * 0.1) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r",
    "predefined_split_alias": "SELECT CASE doc_id % 4 WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split, quality, count(*) AS rows FROM labels GROUP BY ALL",
    "row_ids": "SELECT count(*) AS n, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS different FROM labels",
    "confusion_metrics": f"WITH {MET} SELECT source, n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "error_summary": f"WITH {JUDGE} SELECT 'error_type' AS level, '' AS source, error_type, count(*) AS errors, round(avg(conf), 6) AS mean_confidence FROM e WHERE is_error GROUP BY error_type UNION ALL SELECT 'source', source, error_type, count(*), round(avg(conf), 6) FROM e WHERE is_error GROUP BY source, error_type",
    "ranked_errors": f"WITH {JUDGE} SELECT doc_id, round(conf, 6) AS pred_confidence FROM e WHERE error_type = 'FN' ORDER BY conf DESC, doc_id LIMIT 50",
    "side_by_side_buckets": "WITH d AS (SELECT quality AS g, n_chars / (n_chars + 1500.0) >= 0.5 AS a, n_chars / (n_chars + 700.0) >= 0.5 AS b FROM labels JOIN documents USING (doc_id)), w AS (SELECT a::INT <> g AS x, b::INT <> g AS y FROM d) SELECT CASE WHEN x AND y THEN 'both_wrong' WHEN x THEN 'broad_only_wrong' WHEN y THEN 'strict_only_wrong' ELSE 'both_correct' END AS error_bucket, count(*) AS n FROM w GROUP BY 1",
    "label_diagnosis": f"""WITH {MET}, k AS (SELECT source, error_type, count(*) AS n FROM e WHERE is_error GROUP BY source, error_type QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, error_type) = 1),
 f AS (SELECT source AS label_standard, f1, coalesce(error_type, '') AS dominant_error, coalesce(k.n, 0) AS dominant_error_count, CASE WHEN f1 >= 0.85 THEN 'overall_ok' WHEN recall + 0.08 < precision THEN 'recall_low' WHEN precision + 0.08 < recall THEN 'precision_low' ELSE 'mixed_errors' END AS focus FROM m LEFT JOIN k USING (source))
 SELECT label_standard, round(f1, 6) AS f1, dominant_error, dominant_error_count, focus, CASE focus WHEN 'recall_low' THEN 'errors_fn' WHEN 'precision_low' THEN 'errors_fp' ELSE 'errors_ranked' END AS suggested_file, 0::DOUBLE AS f1_gap FROM f""",
    "metric_rows": f"WITH {MET} SELECT source, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT source, accuracy::DOUBLE AS accuracy, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1 FROM m) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)",
    "macro_mapping_rules": f"WITH {MONTH}, {MAPPED} SELECT topic_id, doc_count, macro_topic, report_action, CASE macro_topic WHEN 'low things' THEN 'fallback' WHEN 'other' THEN 'fallback-other' ELSE 'rule' END AS merge_source FROM m",
    "macro_share_excl_periods": f"WITH {YEAR}, {MACRO_SHARES} SELECT macro_topic, period_label, doc_count, round(doc_share, 6) AS doc_share FROM ms",
    "macro_overview": f"""WITH {YEAR}, {MACRO_SHARES}, g AS (SELECT macro_topic, max(report_action) AS report_action, count(*) AS topic_n, sum(doc_count)::BIGINT AS doc_n, string_agg(topic_id, ', ' ORDER BY doc_count DESC, topic_id) AS top_topic_ids, string_agg(top_terms, ' || ' ORDER BY doc_count DESC, topic_id) AS example_terms FROM m GROUP BY macro_topic),
 k AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY macro_topic ORDER BY doc_share DESC, doc_count DESC, period_label) = 1)
 SELECT g.*, round(doc_n * 100.0 / sum(doc_n) OVER (), 6) AS share_of_clustered_docs_pct, period_label AS peak_period, doc_count AS peak_doc_count, round(doc_share, 6) AS peak_doc_share FROM g JOIN k USING (macro_topic)""",
    "action_share": f"WITH {YEAR}, {MAPPED}, s AS (SELECT period_label, topic_id, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY period_label) AS share FROM p GROUP BY period_label, topic_id) SELECT period_label, report_action, sum(n)::BIGINT AS doc_count, round(sum(share), 6) AS doc_share FROM s JOIN m USING (topic_id) GROUP BY ALL",
    "macro_pivot": f"WITH {YEAR}, {MACRO_SHARES} SELECT macro_topic, " + ", ".join(f'round(coalesce(sum(doc_share) FILTER (WHERE period_label = \'{y}\'), 0), 6) AS "{y}"' for y in (1996, 1997, 1998)) + " FROM ms GROUP BY macro_topic",
    "metric_cards": f"WITH {MONTH}, {MAPPED} SELECT count(*) AS topics, count(DISTINCT macro_topic) AS macro_topics, sum(doc_count)::BIGINT AS docs, " + ", ".join(f"round(coalesce(sum(doc_count) FILTER (WHERE report_action = '{a}'), 0) / sum(doc_count), 6) AS {a}_share" for a in macro.ACTIONS) + " FROM m",
    "sweep_gate": """WITH t AS (SELECT label - 1 AS topic_id, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id = -1 ORDER BY n DESC, topic_id) AS k FROM t),
 g AS (SELECT coalesce(sum(n) FILTER (WHERE topic_id = -1), 0) / sum(n) AS o, count(*) FILTER (WHERE topic_id <> -1) AS c, sum(n) FILTER (WHERE topic_id <> -1 AND k <= 10) / sum(n) FILTER (WHERE topic_id <> -1) AS t FROM r)
 SELECT round(o, 6) AS outlier_share, c AS topic_count, round(t, 6) AS top10_share, o <= 0.45 AND c BETWEEN 8 AND 15 AS gate_compact, o <= 0.05 AND c BETWEEN 80 AND 220 AND t <= 0.35 AS gate_fine FROM g""",
    "annotation_merge": "SELECT 'id:' || doc_id AS merge_key, doc_id::VARCHAR AS id, source AS cleaned_text, lang AS keyword, CASE WHEN doc_id % 3 > 0 THEN quality::VARCHAR ELSE '2' END AS broad, toxic::VARCHAR AS strict FROM labels JOIN documents USING (doc_id)",
    "annotation_conflicts": """WITH m AS (SELECT doc_id, quality, toxic, source FROM labels JOIN documents USING (doc_id)) SELECT 'id:' || doc_id AS merge_key, 'cleaned_text' AS field, source AS kept, 'x' AS value FROM m
 UNION ALL SELECT 'id:' || doc_id, 'broad', quality::VARCHAR, '2' FROM m WHERE doc_id % 3 > 0 AND quality = 1 UNION ALL SELECT 'id:' || doc_id, 'strict', '0', '1' FROM m WHERE doc_id % 5 = 0 AND toxic = 0""",
    "label_orders": """WITH l AS (SELECT 'period' AS kind, CASE WHEN doc_id % 5 = 0 THEN 'NA' ELSE source END AS label FROM documents UNION SELECT 'region', CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN_IP' ELSE 'Z' || lang END FROM documents WHERE doc_id % 7 <> 1)
 SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY label IN ('NA', 'UNKNOWN_IP'), label)::INT AS ord FROM l WHERE label <> ''""",
    "value_counts": "SELECT coalesce(event_type, 'NA') AS value, count(*) AS rows FROM events GROUP BY 1",
    "semantic_headlines": f"WITH {scored_sql()} SELECT keyword, period_label, term, round(pmi, 6) AS pmi, row_number() OVER (PARTITION BY keyword ORDER BY term_rank, pmi DESC, period_label, term)::INT AS headline_rank FROM scored WHERE period_label = 'ALL' QUALIFY headline_rank <= 12",
    "drift_watchlist": " UNION ALL ".join(f"(SELECT '{name}' AS drift_source, {focus} AS focus, previous_period, current_period, round(topic_js_divergence, 5) AS drift_score FROM ({_drift_sql(groups, f'WITH {YEAR}', 'previous_period, current_period, js AS topic_js_divergence', 'd')}) QUALIFY row_number() OVER (PARTITION BY {focus} ORDER BY round(topic_js_divergence, 9) DESC, current_period) = 1)" for name, focus, groups in (("keyword", "keyword", ["keyword"]), ("region", "region", ["region"]), ("overall", "''", []))),
    "top_events": "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id)::INT AS rank FROM events QUALIFY rank <= 10",
} | {name: _share_sql(groups) for name, groups in _SHARES.items()}
