"""Registered queries on terms, candidates and drift, with their DuckDB counterparts.

Documents stand for posts: lang is the keyword, source the region, and the period where no date is at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import cooccurrence, drift, shortlist
from ..operators.ranking import top_n
from ..sources.sinks import written

RULES = [("question", ["wh", "ho"]), ("place", ["ou", "ra"]), ("time", ["ti", "ed"]), ("thing", ["th", "en"])]
NOISE = ["the", "der", "les", "que"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, which two engines agree on."""
    return df.select(*[F.round(F.col(c), places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def posts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.col("lang").alias("keyword"), F.col("source").alias("period_label"), "text", tokens("text").alias("tokens"), "n_chars")


def scored(spark, sf, least=5, top=50):
    return cooccurrence.score_terms(posts(spark, sf), min_doc_freq=least, top_k=top)


POSTS = """posts AS (SELECT doc_id, lang AS keyword, source AS period_label, text, n_chars,
  list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^p?[0-9]+$')) AS tokens FROM documents)"""


def scored_sql(least: int = 5, top: int = 50, levels: str = "unnest(['ALL', period_label])") -> str:
    return f"""{POSTS}, leveled AS (SELECT doc_id, keyword, {levels} AS period_label, tokens FROM posts),
 n AS (SELECT keyword, period_label, count(*) AS doc_count_in_keyword FROM leveled GROUP BY ALL),
 docs AS (SELECT *, sum(doc_count_in_keyword) OVER (PARTITION BY period_label)::BIGINT AS doc_count_in_reference FROM n),
 df AS (SELECT keyword, period_label, term, count(*) AS term_doc_freq FROM (SELECT keyword, period_label, unnest(list_distinct(tokens)) AS term FROM leveled) GROUP BY ALL),
 tf AS (SELECT keyword, period_label, term, count(*) AS term_tf FROM (SELECT keyword, period_label, unnest(tokens) AS term FROM leveled) GROUP BY ALL),
 ref AS (SELECT period_label, term, sum(term_doc_freq)::BIGINT AS reference_doc_freq FROM df GROUP BY ALL),
 base AS (SELECT df.keyword, df.period_label, doc_count_in_keyword, doc_count_in_reference, df.term, term_doc_freq, term_tf,
   term_doc_freq / doc_count_in_keyword AS term_doc_rate, reference_doc_freq, reference_doc_freq / doc_count_in_reference AS reference_doc_rate,
   log2(term_doc_freq::DOUBLE * doc_count_in_reference / (doc_count_in_keyword::DOUBLE * reference_doc_freq)) AS pmi,
   (term_doc_freq::DOUBLE / doc_count_in_keyword) / (reference_doc_freq::DOUBLE / doc_count_in_reference) AS lift
   FROM df JOIN tf USING (keyword, period_label, term) JOIN ref USING (period_label, term) JOIN docs USING (keyword, period_label)
   WHERE term_doc_freq >= {least} AND term <> keyword),
 scored AS (SELECT *, row_number() OVER (PARTITION BY keyword, period_label ORDER BY pmi DESC, term_doc_freq DESC, term_tf DESC, term)::INT AS term_rank FROM base QUALIFY term_rank <= {top})"""


SCORED_COLUMNS = "keyword, period_label, doc_count_in_keyword, doc_count_in_reference, term, term_doc_freq, term_tf, round(term_doc_rate, 6) AS term_doc_rate, reference_doc_freq, round(reference_doc_rate, 6) AS reference_doc_rate, round(pmi, 6) AS pmi, round(lift, 6) AS lift, term_rank"


def pmi_topk(spark, sf):
    return rounded(scored(spark, sf))


def doc_term_freq(spark, sf):
    return cooccurrence.term_counts(posts(spark, sf), "tokens", ["keyword"])


def ctfidf_topk(spark, sf):
    return rounded(cooccurrence.class_tfidf(posts(spark, sf), "keyword", "tokens"))


def _vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", "label", F.col("embedding").alias("vector"))


def semantic_neighbors_cosine(spark, sf):
    """Vectors stand for terms: each label's first vector for the keyword, the label's others for its terms."""
    e = _vectors(spark, sf)
    first = e.groupBy("label").agg(F.min("vec_id").alias("k"))
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    terms = e.join(first, "label").where("vec_id <> k").select(name("k").alias("keyword"), F.lit("ALL").alias("period_label"), name("vec_id").alias("term"), F.col("vec_id").alias("term_doc_freq"), F.lit(0.5).alias("term_doc_rate"), (F.col("vec_id") % 97 / 97.0).alias("pmi"))
    return rounded(cooccurrence.semantic_neighbors(terms, e.select(name("vec_id").alias("term"), "vector")), 5)


def _candidates(spark, sf, rows=None):
    """Scored terms are written once, and everything else is counted from that small table."""
    rows = rows or written(scored(spark, sf))
    near = rows.select("keyword", "period_label", F.col("term").alias("neighbor_term"), (F.col("term_rank") / 50.0).alias("embedding_similarity"), F.col("term_rank").alias("neighbor_rank")).where(F.col("neighbor_rank") <= 20)
    return shortlist.candidates(rows, near, RULES, NOISE)


CANDIDATES = scored_sql() + """,
 near AS (SELECT keyword, period_label, term, term_rank / 50.0 AS embedding_similarity, term_rank AS neighbor_rank FROM scored WHERE term_rank <= 20),
 reasons AS (SELECT s.*, embedding_similarity, neighbor_rank, regexp_matches(term, '^[A-Za-z0-9._-]+$') AS r1,
   NOT regexp_matches(term, '^[A-Za-z0-9._-]+$') AND regexp_matches(term, '[A-Za-z]') AND regexp_matches(term, '[0-9]') AS r2,
   term IN ('the', 'der', 'les', 'que') AS r3, contains(term, keyword) AS r4 FROM scored s LEFT JOIN near USING (keyword, period_label, term)),
 candidates AS (SELECT *, concat_ws('|', CASE WHEN r2 THEN 'alpha_numeric_noise' END, CASE WHEN r1 THEN 'ascii_or_id_term' END, CASE WHEN r3 THEN 'custom_noise_term' END, CASE WHEN r4 THEN 'keyword_self_variant' END) AS auto_drop_reasons,
   CASE WHEN r4 THEN '关键词自变体' WHEN r1 OR r2 OR r3 THEN '账号/代码噪声' WHEN contains(term, 'wh') OR contains(term, 'ho') THEN 'question' WHEN contains(term, 'ou') OR contains(term, 'ra') THEN 'place' WHEN contains(term, 'ti') OR contains(term, 'ed') THEN 'time' WHEN contains(term, 'th') OR contains(term, 'en') THEN 'thing' ELSE '其他' END AS auto_theme_bucket,
   r1 OR r2 OR r3 OR r4 AS auto_noise_flag, embedding_similarity IS NOT NULL AS semantic_supported,
   ln(1 + term_doc_freq::DOUBLE) * lift * (1 + greatest(coalesce(embedding_similarity::DOUBLE, 0), 0)) AS midterm_score,
   period_label <> 'ALL' AND term_doc_freq >= 500 AND lift <= 1.05 AS low_specificity_flag FROM reasons)"""


def midterm_candidates(spark, sf):
    return rounded(_candidates(spark, sf).drop("term_doc_rate", "reference_doc_rate", "neighbor_rank"))


def noise_diagnostics(spark, sf):
    return shortlist.noise_diagnostics(_candidates(spark, sf))


def _kept(spark, sf, candidates=None):
    # tokens of the test documents are all ASCII: what would be noise there is kept
    return (candidates or _candidates(spark, sf)).withColumn("auto_keep_for_midterm", ~F.contains(F.col("term"), F.col("keyword")))


def midterm_shortlist_overall(spark, sf):
    return rounded(shortlist.shortlists(_kept(spark, sf), 18, 20)[0].select("keyword", "period_label", "term", "term_doc_freq", "midterm_score", "shortlist_rank"))


def midterm_shortlist_period(spark, sf):
    return rounded(shortlist.shortlists(_kept(spark, sf), period_n=6, period_df=8)[1].select("keyword", "period_label", "term", "term_doc_freq", "midterm_score", "shortlist_rank"))


BY_SCORE = "ORDER BY midterm_score DESC, term_doc_freq DESC, lift DESC, term"
SHORT = "keyword, period_label, term, term_doc_freq, round(midterm_score, 6) AS midterm_score, row_number() OVER (PARTITION BY keyword{more} " + BY_SCORE + ")::INT AS shortlist_rank"


def _matches(spark, sf, best=None):
    rows = posts(spark, sf).select("doc_id", "keyword", "period_label", "tokens", shortlist.document_preview("text").alias("preview"), F.col("n_chars").alias("score"))
    return shortlist.matches(rows, best or scored(spark, sf, top=5))


MATCHES = scored_sql(top=5) + """,
 prev AS (SELECT doc_id, keyword, period_label AS example_period, n_chars AS score, tokens, trim(replace(text, chr(10), ' ')) AS t FROM posts),
 cut AS (SELECT * EXCLUDE t, CASE WHEN length(t) > 140 THEN substring(t, 1, 137) || '...' ELSE t END AS preview FROM prev),
 lev AS (SELECT keyword, example_period, doc_id, score, preview, term, unnest(['ALL', example_period]) AS period_label FROM (SELECT *, unnest(list_distinct(tokens)) AS term FROM cut)),
 found AS (SELECT lev.* FROM lev JOIN scored USING (keyword, period_label, term))"""


def match_stats(spark, sf):
    return rounded(shortlist.match_stats(_matches(spark, sf)))


def example_topn(spark, sf):
    return shortlist.examples(_matches(spark, sf))


def wide_examples(spark, sf):
    return shortlist.wide_examples(shortlist.examples(_matches(spark, sf)))


EXAMPLES = MATCHES + """,
 per AS (SELECT keyword, period_label, term, preview, max(score) AS score, arg_min(doc_id, (-score, doc_id)) AS doc_id, arg_min(example_period, (-score, doc_id)) AS example_period FROM found GROUP BY ALL),
 examples AS (SELECT *, row_number() OVER (PARTITION BY keyword, period_label, term ORDER BY score DESC, doc_id)::INT AS example_rank FROM per QUALIFY example_rank <= 3)"""


def diversity_rerank(spark, sf):
    best = written(scored(spark, sf))  # terms are scored once for both
    kept = _kept(spark, sf, _candidates(spark, sf, best)).where("period_label = 'ALL'")
    rows = shortlist.with_match_stats(kept, shortlist.match_stats(_matches(spark, sf, best.where("period_label = 'ALL' and term_rank <= 5"))))
    return rounded(shortlist.diverse(rows, 10).select("keyword", "term", "matched_doc_count", "distinct_text_count", "top_text_share", "shortlist_rank"))


def _bucketed(spark, sf, candidates=None):
    from ..functions.text import first_bucket

    return (candidates or _candidates(spark, sf)).where("period_label <> 'ALL'").withColumn("context_bucket", first_bucket("term", RULES, "other")).withColumn("theme_bucket", F.col("auto_theme_bucket"))


BUCKET = "CASE WHEN contains(term, 'wh') OR contains(term, 'ho') THEN 'question' WHEN contains(term, 'ou') OR contains(term, 'ra') THEN 'place' WHEN contains(term, 'ti') OR contains(term, 'ed') THEN 'time' WHEN contains(term, 'th') OR contains(term, 'en') THEN 'thing' ELSE 'other' END"
TRAJECTORY = CANDIDATES + f""",
 bucketed AS (SELECT *, {BUCKET} AS context_bucket FROM candidates WHERE period_label <> 'ALL'),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY keyword, period_label, context_bucket {BY_SCORE}) AS k FROM bucketed),
 agg AS (SELECT keyword, period_label, context_bucket, max(doc_count_in_keyword) AS doc_count_in_keyword, count(*) AS context_term_count, sum(term_doc_freq)::BIGINT AS context_term_doc_freq_sum,
   sum(midterm_score) AS context_midterm_score_sum, string_agg(term, ' / ' ORDER BY k) FILTER (WHERE k <= 4) AS lead_terms FROM ranked GROUP BY ALL),
 trajectory AS (SELECT *, context_term_doc_freq_sum / sum(context_term_doc_freq_sum) OVER w AS context_doc_freq_share, context_midterm_score_sum / sum(context_midterm_score_sum) OVER w AS context_score_share FROM agg WINDOW w AS (PARTITION BY keyword, period_label))"""


def context_trajectory(spark, sf):
    return rounded(shortlist.context_trajectory(_bucketed(spark, sf)))


def context_shift_summary(spark, sf):
    return rounded(shortlist.context_shift(shortlist.context_trajectory(_bucketed(spark, sf))).drop("representative_terms_over_time"))


def context_bucket_summary(spark, sf):
    return shortlist.bucket_summary(_bucketed(spark, sf))


def context_override_theta(spark, sf):
    rules = spark.createDataFrame([("en", "", "", "by_keyword", "", "1", "k"), ("", "src0", "", "by_period", "", "true", "p"), ("en", "src1", "", "by_both", "t", "yes", "kp"), ("de", "", "", "off", "", "0", "x")], "keyword string, period_label string, term string, override_context_bucket string, override_theme_bucket string, enabled string, note string")
    out = shortlist.overridden(_bucketed(spark, sf), rules)
    return out.select("keyword", "period_label", "term", "context_bucket", "context_bucket_source", "theme_bucket", "theme_bucket_source", "override_note")


def period_overview_listagg(spark, sf):
    return shortlist.period_overview(scored(spark, sf).withColumn("shortlist_rank", F.col("term_rank")))


def coding_template(spark, sf):
    whole, single = shortlist.shortlists(_kept(spark, sf), 18, 20, 6, 8)
    return rounded(shortlist.coding_template(whole, single).select("keyword", "period_label", "term", "shortlist_rank", "midterm_score", "manual_keep", "coder"))


def override_template(spark, sf):
    whole, single = shortlist.shortlists(_kept(spark, sf), 18, 20, 6, 8)
    return shortlist.override_template(whole, single)


def midterm_counters(spark, sf):
    """Rows of every table of the mid-term report."""
    candidates = _candidates(spark, sf)
    kept, bucketed = _kept(spark, sf, candidates), _bucketed(spark, sf, candidates)
    whole, single = shortlist.shortlists(kept, 18, 20, 6, 8)
    trajectory = shortlist.context_trajectory(bucketed)
    tables = {
        "overall_shortlist": whole, "period_shortlist": single, "context_trajectory": trajectory, "context_shift_summary": shortlist.context_shift(trajectory), "noise_diagnostic": shortlist.noise_diagnostics(kept),
        "context_bucket_summary": shortlist.bucket_summary(bucketed), "coding_template": shortlist.coding_template(whole, single), "bucket_override_template": shortlist.override_template(whole, single),
    }
    return shortlist.midterm_counters(kept, tables, len(NOISE), 2)


def summary_counters(spark, sf):
    return shortlist.summary_counters(_candidates(spark, sf))


def drift_ranked_terms(spark, sf):
    return rounded(drift.ranked_term_drift(written(scored(spark, sf)), score="term_doc_freq"))


def drift_collocations(spark, sf):
    """By pmi, which has either sign."""
    return rounded(drift.ranked_term_drift(written(scored(spark, sf))))


def drift_neighbors(spark, sf):
    """Ranks stand for similarities, some of them negative."""
    rows = written(scored(spark, sf)).select("keyword", "period_label", F.col("term").alias("neighbor_term"), (F.col("term_rank") % 7 / 7.0 - 0.2).alias("embedding_similarity"), F.col("term_rank").alias("neighbor_rank"))
    return rounded(drift.ranked_term_drift(rows, "neighbor_term", "embedding_similarity", "neighbor_rank"))


def drift_sql(score: str) -> str:
    return scored_sql() + f""",
 best AS (SELECT keyword, period_label, term, ({score})::DOUBLE AS score FROM scored WHERE period_label NOT IN ('ALL', 'NA') QUALIFY row_number() OVER (PARTITION BY keyword, period_label ORDER BY {score} DESC, term_rank, term) <= 20),
 per AS (SELECT keyword, period_label, lag(period_label) OVER (PARTITION BY keyword ORDER BY period_label) AS previous FROM (SELECT DISTINCT keyword, period_label FROM best)),
 pairs AS (SELECT keyword, previous AS previous_period, period_label AS current_period FROM per WHERE previous IS NOT NULL),
 a AS (SELECT p.*, term, score FROM pairs p JOIN best b ON b.keyword = p.keyword AND b.period_label = previous_period),
 b AS (SELECT p.*, term, score FROM pairs p JOIN best b ON b.keyword = p.keyword AND b.period_label = current_period),
 both_sides AS (SELECT keyword, previous_period, current_period, term, a.score AS old, b.score AS new FROM a FULL JOIN b USING (keyword, previous_period, current_period, term)),
 shares AS (SELECT *, sum(old) OVER w AS olds, sum(new) OVER w AS news, coalesce(old, 0) / nullif(sum(old) OVER w, 0) AS p, coalesce(new, 0) / nullif(sum(new) OVER w, 0) AS q FROM both_sides WINDOW w AS (PARTITION BY keyword, previous_period, current_period)),
 parts AS (SELECT *, (p > 0 OR q > 0) AND p + q <= 0 AS odd, CASE WHEN p > 0 AND p + q > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 AND p + q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END AS part FROM shares)
 SELECT keyword, previous_period, current_period, count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS overlap_count, round(count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) / count(*), 6) AS jaccard_top_terms,
 CASE WHEN max(olds) > 0 AND max(news) > 0 AND NOT bool_or(odd) THEN round(sum(part) / 2, 6) + 0 END AS js_divergence,
 coalesce(string_agg(term, ' | ' ORDER BY term) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL), '') AS overlap_terms, coalesce(string_agg(term, ' | ' ORDER BY term) FILTER (WHERE old IS NULL), '') AS added_terms, coalesce(string_agg(term, ' | ' ORDER BY term) FILTER (WHERE new IS NULL), '') AS removed_terms FROM parts GROUP BY ALL"""


JS = "greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)"


QUERIES = {f.__name__: f for f in (
    pmi_topk, doc_term_freq, ctfidf_topk, semantic_neighbors_cosine, midterm_candidates, noise_diagnostics, midterm_shortlist_overall, midterm_shortlist_period, match_stats, example_topn, wide_examples, diversity_rerank,
    context_trajectory, context_shift_summary, context_bucket_summary, context_override_theta, period_overview_listagg, coding_template, summary_counters, drift_ranked_terms, drift_collocations, drift_neighbors, override_template, midterm_counters,
)}

SQL = {
    "pmi_topk": f"WITH {scored_sql()} SELECT {SCORED_COLUMNS} FROM scored",
    "doc_term_freq": f"WITH {POSTS} SELECT keyword, term, count(*) AS doc_freq, sum(n)::BIGINT AS term_freq FROM (SELECT keyword, doc_id, term, count(*) AS n FROM (SELECT keyword, doc_id, unnest(tokens) AS term FROM posts) GROUP BY ALL) GROUP BY ALL",
    "ctfidf_topk": f"""WITH {POSTS}, c AS (SELECT keyword, term, count(*) AS tf FROM (SELECT keyword, unnest(tokens) AS term FROM posts) GROUP BY ALL), w AS (SELECT *, sum(tf) OVER (PARTITION BY keyword) AS words, sum(tf) OVER (PARTITION BY term) AS uses FROM c),
 m AS (SELECT avg(words) AS mean FROM (SELECT DISTINCT keyword, words FROM w)), x AS (SELECT keyword, term, tf / words * ln(1 + mean / uses) AS weight FROM w, m)
 SELECT keyword AS topic_id, row_number() OVER (PARTITION BY keyword ORDER BY weight DESC, term)::INT AS term_rank, term, round(weight, 6) AS term_weight FROM x QUALIFY term_rank <= 10""",
    "semantic_neighbors_cosine": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, min(vec_id) AS k FROM e GROUP BY label),
 t AS (SELECT k, e.vec_id, e.v, vec_id % 97 / 97.0 AS pmi FROM e JOIN f USING (label) WHERE vec_id <> k), p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY pmi DESC, vec_id DESC, 'v' || vec_id) <= 200),
 s AS (SELECT p.*, list_inner_product(p.v, kv.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(kv.v, kv.v))) AS sim FROM p JOIN e kv ON kv.vec_id = p.k)
 SELECT 'v' || k AS keyword, 'ALL' AS period_label, row_number() OVER (PARTITION BY k ORDER BY sim DESC, 'v' || vec_id)::INT AS neighbor_rank, 'v' || vec_id AS neighbor_term, round(sim, 5) AS embedding_similarity, vec_id AS term_doc_freq, 0.5::DOUBLE AS term_doc_rate, round(pmi::DOUBLE, 5) AS pmi FROM s QUALIFY neighbor_rank <= 20""",
    "midterm_candidates": f"WITH {CANDIDATES} SELECT keyword, period_label, term, doc_count_in_keyword, doc_count_in_reference, term_doc_freq, term_tf, reference_doc_freq, round(pmi, 6) AS pmi, round(lift, 6) AS lift, term_rank, round(embedding_similarity::DOUBLE, 6) AS embedding_similarity, auto_theme_bucket, auto_drop_reasons, auto_noise_flag, semantic_supported, round(midterm_score, 6) AS midterm_score, low_specificity_flag, NOT auto_noise_flag AS auto_keep_for_midterm FROM candidates",
    "noise_diagnostics": f"""WITH {CANDIDATES}, x AS (SELECT unnest(string_split(auto_drop_reasons, '|')) AS reason, term FROM candidates WHERE auto_drop_reasons <> ''), t AS (SELECT reason, term, row_number() OVER (PARTITION BY reason ORDER BY term) AS k FROM (SELECT DISTINCT reason, term FROM x))
 SELECT reason, term_count, sample_terms FROM (SELECT reason, count(*) AS term_count FROM x GROUP BY reason) JOIN (SELECT reason, string_agg(term, ' / ' ORDER BY term) AS sample_terms FROM t WHERE k <= 5 GROUP BY reason) USING (reason)""",
    "midterm_shortlist_overall": f"WITH {CANDIDATES} SELECT {SHORT.format(more='')} FROM candidates WHERE NOT contains(term, keyword) AND period_label = 'ALL' AND term_doc_freq >= 20 QUALIFY shortlist_rank <= 18",
    "midterm_shortlist_period": f"WITH {CANDIDATES} SELECT {SHORT.format(more=', period_label')} FROM candidates WHERE NOT contains(term, keyword) AND period_label <> 'ALL' AND term_doc_freq >= 8 AND NOT low_specificity_flag QUALIFY shortlist_rank <= 6",
    "match_stats": f"WITH {MATCHES}, g AS (SELECT keyword, period_label, term, preview, count(*) AS n FROM found GROUP BY ALL) SELECT keyword, period_label, term, sum(n)::BIGINT AS matched_doc_count, count(*) AS distinct_text_count, round(max(n) / sum(n), 6) AS top_text_share, max(n) / sum(n) > 0.5 AND count(*) < 3 AS template_like_flag FROM g GROUP BY ALL",
    "example_topn": f"WITH {EXAMPLES} SELECT keyword, period_label, term, preview, score, doc_id, example_period, example_rank FROM examples",
    "wide_examples": f"WITH {EXAMPLES} SELECT keyword, period_label, term, " + ", ".join(f"max(CASE WHEN example_rank = {k} THEN {c} END) AS example_{k}_{n}" for k in (1, 2, 3) for n, c in (("text", "preview"), ("period", "example_period"), ("engagement", "score"))) + " FROM examples GROUP BY ALL",
    "diversity_rerank": f"""WITH {CANDIDATES}, five AS (SELECT keyword AS keyword, period_label, term FROM scored WHERE term_rank <= 5),
 prev AS (SELECT doc_id, keyword, tokens, trim(replace(text, chr(10), ' ')) AS t FROM posts), cut AS (SELECT keyword, tokens, CASE WHEN length(t) > 140 THEN substring(t, 1, 137) || '...' ELSE t END AS preview FROM prev),
 found AS (SELECT c.* FROM (SELECT keyword, preview, unnest(list_distinct(tokens)) AS term FROM cut) c JOIN five f ON f.keyword = c.keyword AND f.term = c.term AND f.period_label = 'ALL'),
 g AS (SELECT keyword, term, preview, count(*) AS n FROM found GROUP BY ALL), stats AS (SELECT keyword, term, sum(n)::BIGINT AS matched_doc_count, count(*) AS distinct_text_count, max(n) / sum(n) AS top_text_share FROM g GROUP BY ALL),
 j AS (SELECT c.*, coalesce(matched_doc_count, 0) AS matched_doc_count, coalesce(distinct_text_count, 0) AS distinct_text_count, coalesce(top_text_share, 0) AS top_text_share FROM candidates c LEFT JOIN stats USING (keyword, term) WHERE period_label = 'ALL')
 SELECT keyword, term, matched_doc_count, distinct_text_count, round(top_text_share, 6) AS top_text_share, row_number() OVER (PARTITION BY keyword ORDER BY (distinct_text_count >= 3 AND top_text_share <= 0.5) DESC, midterm_score DESC, term_doc_freq DESC, lift DESC, term)::INT AS shortlist_rank FROM j QUALIFY shortlist_rank <= 10""",
    "context_trajectory": f"WITH {TRAJECTORY} SELECT keyword, period_label, context_bucket, doc_count_in_keyword, context_term_count, context_term_doc_freq_sum, round(context_midterm_score_sum, 6) AS context_midterm_score_sum, lead_terms, round(context_doc_freq_share, 6) AS context_doc_freq_share, round(context_score_share, 6) AS context_score_share FROM trajectory",
    "context_shift_summary": f"""WITH {TRAJECTORY} SELECT keyword, context_bucket, count(*) AS period_count, min(period_label) AS first_period, round(arg_min(context_score_share, period_label), 6) AS first_context_score_share, max(period_label) AS latest_period,
 round(arg_max(context_score_share, period_label), 6) AS latest_context_score_share, round(arg_max(context_score_share, period_label) - arg_min(context_score_share, period_label), 6) AS score_share_change, arg_min(period_label, (-context_score_share, period_label)) AS peak_period,
 round(max(context_score_share), 6) AS peak_context_score_share, round(avg(context_score_share), 6) AS avg_context_score_share FROM trajectory GROUP BY ALL""",
    "context_bucket_summary": f"WITH {TRAJECTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY keyword, context_bucket {BY_SCORE}, period_label) AS n FROM bucketed) SELECT keyword, context_bucket, count(*) AS term_count, string_agg(term, ' / ' ORDER BY n) FILTER (WHERE n <= 5) AS top_terms FROM r GROUP BY ALL",
    "context_override_theta": f"""WITH {TRAJECTORY}, o AS (SELECT *, CASE WHEN keyword = 'en' AND period_label = 'src1' THEN 3 WHEN keyword = 'en' THEN 2 WHEN period_label = 'src0' THEN 1 ELSE 0 END AS k FROM bucketed)
 SELECT keyword, period_label, term, CASE k WHEN 3 THEN 'by_both' WHEN 2 THEN 'by_keyword' WHEN 1 THEN 'by_period' ELSE context_bucket END AS context_bucket, CASE WHEN k > 0 THEN 'override' ELSE 'auto' END AS context_bucket_source,
 CASE k WHEN 3 THEN 't' ELSE auto_theme_bucket END AS theme_bucket, CASE WHEN k = 3 THEN 'override' ELSE 'auto' END AS theme_bucket_source, CASE k WHEN 3 THEN 'kp' WHEN 2 THEN 'k' WHEN 1 THEN 'p' ELSE '' END AS override_note FROM o""",
    "period_overview_listagg": f"WITH {scored_sql()} SELECT keyword, period_label, max(doc_count_in_keyword) AS doc_count, string_agg(term || '(' || term_doc_freq || ')', ' / ' ORDER BY term_rank) AS top_terms FROM scored WHERE term_rank <= 6 GROUP BY ALL",
    "coding_template": f"""WITH {CANDIDATES}, w AS (SELECT {SHORT.format(more='')} FROM candidates WHERE NOT contains(term, keyword) AND period_label = 'ALL' AND term_doc_freq >= 20 QUALIFY shortlist_rank <= 18),
 s AS (SELECT {SHORT.format(more=', period_label')} FROM candidates WHERE NOT contains(term, keyword) AND period_label <> 'ALL' AND term_doc_freq >= 8 AND NOT low_specificity_flag QUALIFY shortlist_rank <= 6)
 SELECT keyword, period_label, term, shortlist_rank, midterm_score, '' AS manual_keep, '' AS coder FROM (SELECT * FROM w UNION ALL SELECT * FROM s)""",
    "summary_counters": f"WITH {CANDIDATES} SELECT count(*) AS candidate_rows, count(*) FILTER (WHERE auto_noise_flag) AS noise_rows, count(*) FILTER (WHERE NOT auto_noise_flag) AS kept_rows, count(*) FILTER (WHERE semantic_supported) AS semantic_rows, count(*) FILTER (WHERE low_specificity_flag) AS low_specificity_rows, count(*) FILTER (WHERE period_label = 'ALL') AS overall_rows FROM candidates",
    "drift_ranked_terms": f"WITH {drift_sql('term_doc_freq')}",
    "drift_collocations": f"WITH {drift_sql('pmi')}",
    "drift_neighbors": f"WITH {drift_sql('term_rank % 7 / 7.0 - 0.2')}",
    "override_template": f"""WITH {CANDIDATES}, w AS (SELECT auto_theme_bucket, {SHORT.format(more='')} FROM candidates WHERE NOT contains(term, keyword) AND period_label = 'ALL' AND term_doc_freq >= 20 QUALIFY shortlist_rank <= 18),
 s AS (SELECT auto_theme_bucket, {SHORT.format(more=', period_label')} FROM candidates WHERE NOT contains(term, keyword) AND period_label <> 'ALL' AND term_doc_freq >= 8 AND NOT low_specificity_flag QUALIFY shortlist_rank <= 6)
 SELECT keyword, period_label, term, '' AS override_context_bucket, auto_theme_bucket, '' AS override_theme_bucket, '' AS enabled, '' AS note FROM (SELECT * FROM w UNION ALL SELECT * FROM s)""",
}

COUNTED = {"overall_shortlist": "midterm_shortlist_overall", "period_shortlist": "midterm_shortlist_period", "context_trajectory": "context_trajectory", "context_shift_summary": "context_shift_summary", "noise_diagnostic": "noise_diagnostics", "context_bucket_summary": "context_bucket_summary", "coding_template": "coding_template", "bucket_override_template": "override_template"}
SQL["midterm_counters"] = (
    f"SELECT *, 4 AS exact_noise_term_count, 2 AS bucket_override_count FROM (WITH {CANDIDATES} SELECT count(*) AS candidate_row_count, count(*) FILTER (WHERE NOT contains(term, keyword)) AS auto_keep_row_count FROM candidates)"
    + "".join(f", (SELECT count(*) AS {name}_row_count FROM ({SQL[q]}))" for name, q in COUNTED.items())
)
