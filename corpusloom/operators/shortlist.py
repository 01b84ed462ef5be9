"""Report candidates from scored terms: noise flags, shortlists, examples, context buckets and their course."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import midterm_score
from ..functions.text import first_bucket, truncate
from ..sources.sinks import written
from .dedup import keep_first
from .ranking import first_of, ordered_terms, share_of, tiered_top_n, top_n

# Names and patterns of term noise.
RECRUITING = "(进团|代招|招代招|回官博|官博|单秒|男店)"
SELF, CODE, OTHER = "关键词自变体", "账号/代码噪声", "其他"


def order_by_score(term: str = "term") -> list[Column]:
    return [F.col("midterm_score").desc(), F.col("term_doc_freq").desc(), F.col("lift").desc(), F.col(term).asc()]


def classify_terms(df: DataFrame, rules: list[tuple[str, list[str]]], noise: Sequence[str] = (), term: str = "term", keyword: str = "keyword") -> DataFrame:
    """Adds drop_reasons (sorted array) and auto_theme_bucket."""
    t = F.col(term)
    ascii_only = t.rlike("^[A-Za-z0-9._-]+$")
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(ascii_only, "ascii_or_id_term"),
        F.when(~ascii_only & t.rlike("[A-Za-z]") & t.rlike("(?U)\\d"), "alpha_numeric_noise"),
        F.when(t.isin(list(noise)), "custom_noise_term") if noise else F.lit(None).cast("string"),
        F.when(F.contains(t, F.col(keyword)), "keyword_self_variant"),
        F.when(t.rlike(RECRUITING), "platform_recruitment"),
    )))
    out = df.withColumn("drop_reasons", reasons)
    code = F.arrays_overlap("drop_reasons", F.array(*map(F.lit, ("ascii_or_id_term", "alpha_numeric_noise", "custom_noise_term"))))
    theme = F.when(F.array_contains("drop_reasons", "keyword_self_variant"), SELF).when(code, CODE).otherwise(first_bucket(t, rules, OTHER))
    return out.withColumn("auto_theme_bucket", theme)


def candidates(scored: DataFrame, neighbors: DataFrame, rules: list[tuple[str, list[str]]], noise: Sequence[str] = ()) -> DataFrame:
    """Scored terms with their neighbour similarity, noise flags, theme and score."""
    near = neighbors.select("keyword", "period_label", F.col("neighbor_term").alias("term"), "embedding_similarity", "neighbor_rank")
    out = classify_terms(scored.join(near, ["keyword", "period_label", "term"], "left"), rules, noise)
    out = out.withColumn("auto_drop_reasons", F.array_join("drop_reasons", "|")).withColumn("auto_noise_flag", F.size("drop_reasons") > 0).drop("drop_reasons")
    out = out.withColumn("semantic_supported", F.col("embedding_similarity").isNotNull())
    out = out.withColumn("midterm_score", midterm_score(F.col("term_doc_freq"), F.col("lift"), F.col("embedding_similarity")))
    low = (F.col("period_label") != "ALL") & (F.col("term_doc_freq") >= 500) & (F.col("lift") <= 1.05)
    return out.withColumn("low_specificity_flag", F.coalesce(low, F.lit(False))).withColumn("auto_keep_for_midterm", ~F.col("auto_noise_flag"))


def shortlists(df: DataFrame, overall_n: int = 18, overall_df: int = 60, period_n: int = 6, period_df: int = 20) -> tuple[DataFrame, DataFrame]:
    """Best kept terms of each keyword over all periods, and of each period without unspecific ones."""
    kept = df.where("auto_keep_for_midterm")
    whole = top_n(kept.where((F.col("period_label") == "ALL") & (F.col("term_doc_freq") >= overall_df)), ["keyword"], order_by_score(), overall_n, "shortlist_rank")
    single = kept.where((F.col("period_label") != "ALL") & (F.col("term_doc_freq") >= period_df) & ~F.col("low_specificity_flag"))
    return whole, top_n(single, ["keyword", "period_label"], order_by_score(), period_n, "shortlist_rank")


def diverse(df: DataFrame, n: int = 18) -> DataFrame:
    """Terms that several different texts use first, others to fill up."""
    return tiered_top_n(df, ["keyword"], (F.col("distinct_text_count") >= 3) & (F.col("top_text_share") <= 0.5), order_by_score(), n, "shortlist_rank")


def matches(docs: DataFrame, requested: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Documents (keyword, period_label, tokens, preview, score) with each requested (keyword, period_label, term) they contain, ALL included."""
    # a table of its own, whose size Spark knows: a few terms go to all documents, instead of all tokens to them
    wanted = written(requested.select("keyword", F.col("period_label").alias("_level"), "term").distinct())
    # outer, since Spark would look at the tokens' size first otherwise, and make them twice for that
    rows = docs.withColumn("term", F.explode_outer(F.array_distinct(tokens))).drop(tokens).join(wanted, ["keyword", "term"])
    return rows.withColumn("_own", F.explode(F.array(F.lit("ALL"), F.col("period_label")))).where("_own = _level").drop("_own")


def match_stats(found: DataFrame) -> DataFrame:
    """Matches, different previews and the largest preview's share of each requested term; template-like where few texts make up most."""
    texts = found.groupBy("keyword", "_level", "term", "preview").agg(F.count("*").alias("_n"))
    out = texts.groupBy("keyword", F.col("_level").alias("period_label"), "term").agg(F.sum("_n").alias("matched_doc_count"), F.count("*").alias("distinct_text_count"), (F.max("_n") / F.sum("_n")).alias("top_text_share"))
    return out.withColumn("template_like_flag", (F.col("top_text_share") > 0.5) & (F.col("distinct_text_count") < 3))


def with_match_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    zero = {"matched_doc_count": 0, "distinct_text_count": 0, "top_text_share": 0.0, "template_like_flag": False}
    return df.join(stats, ["keyword", "period_label", "term"], "left").na.fill(zero)


def examples(found: DataFrame, n: int = 3, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The n best documents of each requested term, one a preview, by score then id."""
    order = [F.col(score).desc(), F.col(tie).asc()]
    best = found.groupBy("keyword", "_level", "term", "preview").agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), F.col("period_label").alias("p"))).alias("_b"))
    best = best.select("keyword", F.col("_level").alias("period_label"), "term", "preview", (-F.col("_b.s")).alias(score), F.col("_b.t").alias(tie), F.col("_b.p").alias("example_period"))
    return top_n(best, ["keyword", "period_label", "term"], order, n, "example_rank")


def wide_examples(found: DataFrame, n: int = 3, score: str = "score") -> DataFrame:
    """Examples as columns example_1_text, example_1_period, example_1_engagement and so on."""
    pick = lambda k, c: F.max(F.when(F.col("example_rank") == k, F.col(c)))
    columns = [pick(k, c).alias(f"example_{k}_{name}") for k in range(1, n + 1) for name, c in (("text", "preview"), ("period", "example_period"), ("engagement", score))]
    return found.groupBy("keyword", "period_label", "term").agg(*columns)


def engagement_score(likes: Column, comments: Column, reposts: Column) -> Column:
    return likes + 2 * comments + 3 * reposts


def document_preview(text: str | Column) -> Column:
    return truncate(text, 140)


def overridden(df: DataFrame, overrides: DataFrame, targets: Sequence[str] = ("context_bucket", "theme_bucket")) -> DataFrame:
    """Columns replaced by hand-made rules (keyword, period_label, term, override_<target>, enabled, note).

    A blank field of a rule matches everything. Of several the most specific wins: by keyword, period, term, then their
    names. Each <target>_source tells whether a rule or the program set it. The rule table is small and kept by hand.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    keys = ["keyword", "period_label", "term"]
    rules = overrides.where(F.lower(F.coalesce(F.col("enabled").cast("string"), F.lit("1"))).isin("1", "true", "yes", "y"))
    rules = rules.select(*[blank(k).alias(f"_{k}") for k in keys], *[blank(f"override_{t}").alias(f"_new_{t}") for t in targets], blank("note").alias("override_note"))
    rules = rules.where(F.greatest(*[F.length(f"_new_{t}") for t in targets]) > 0)
    fits = F.lit(True)
    for k in keys:
        fits = fits & ((F.col(f"_{k}") == "") | (F.col(f"_{k}") == F.col(k)))
    asked = df.select(*keys).distinct()
    found = asked.join(F.broadcast(rules), fits)
    found = first_of(found, keys, [*[(F.col(f"_{k}") != "").desc() for k in keys], *[F.col(f"_new_{t}").asc() for t in targets], F.col("override_note").asc()])
    out = df.join(found.drop(*[f"_{k}" for k in keys]), keys, "left")
    for t in targets:
        hand = F.coalesce(F.col(f"_new_{t}"), F.lit("")) != ""
        out = out.withColumn(f"{t}_source", F.when(hand, "override").otherwise("auto")).withColumn(t, F.when(hand, F.col(f"_new_{t}")).otherwise(F.col(t)))
    return out.drop(*[f"_new_{t}" for t in targets]).na.fill({"override_note": ""})


def context_trajectory(df: DataFrame, lead: int = 4) -> DataFrame:
    """Terms, frequency and score of each context bucket in each period, their shares of the period, and its first terms."""
    keys = ["keyword", "period_label"]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "context_bucket").orderBy(*order_by_score())))
    out = ranked.groupBy(*keys, "context_bucket").agg(
        F.max("doc_count_in_keyword").alias("doc_count_in_keyword"), F.count("*").alias("context_term_count"), F.sum("term_doc_freq").alias("context_term_doc_freq_sum"),
        F.sum("midterm_score").alias("context_midterm_score_sum"), ordered_terms("term", "_rank", lead, " / ").alias("lead_terms"),
    )
    return out.withColumn("context_doc_freq_share", share_of("context_term_doc_freq_sum", keys)).withColumn("context_score_share", share_of("context_midterm_score_sum", keys))


def context_shift(trajectory: DataFrame, most: int = 6) -> DataFrame:
    """First, latest, highest and mean share of each bucket, and the terms that led it in order of appearance."""
    at = F.struct("period_label", "context_score_share")
    periods = F.array_sort(F.collect_list(F.struct("period_label", "lead_terms")))  # one row a period
    terms = F.flatten(F.transform(periods, lambda p: F.transform(F.split(p["lead_terms"], "/"), F.trim)))
    out = trajectory.groupBy("keyword", "context_bucket").agg(
        F.count("*").alias("period_count"), F.min(at).alias("_f"), F.max(at).alias("_l"),
        F.min(F.struct((-F.col("context_score_share")).alias("s"), "period_label")).alias("_p"), F.avg("context_score_share").alias("avg_context_score_share"),
        F.array_join(F.slice(F.filter(F.array_distinct(terms), lambda t: t != ""), 1, most), " / ").alias("representative_terms_over_time"),
    )
    first, latest = F.col("_f.context_score_share"), F.col("_l.context_score_share")
    return out.select(
        "keyword", "context_bucket", "period_count", F.col("_f.period_label").alias("first_period"), first.alias("first_context_score_share"), F.col("_l.period_label").alias("latest_period"),
        latest.alias("latest_context_score_share"), (latest - first).alias("score_share_change"), F.col("_p.period_label").alias("peak_period"), (-F.col("_p.s")).alias("peak_context_score_share"),
        "avg_context_score_share", "representative_terms_over_time",
    )


def bucket_summary(df: DataFrame, n: int = 5) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("keyword", "context_bucket").orderBy(*order_by_score(), F.col("period_label"))))
    return ranked.groupBy("keyword", "context_bucket").agg(F.count("*").alias("term_count"), ordered_terms("term", "_rank", n, " / ").alias("top_terms"))


def period_overview(df: DataFrame, n: int = 6) -> DataFrame:
    """Terms with their frequency, by rank, of each keyword and period."""
    named = df.where(F.col("shortlist_rank") <= n).withColumn("_t", F.concat("term", F.lit("("), F.col("term_doc_freq").cast("string"), F.lit(")")))
    return named.groupBy("keyword", "period_label").agg(F.max("doc_count_in_keyword").alias("doc_count"), ordered_terms("_t", "shortlist_rank", n, " / ").alias("top_terms"))


def noise_diagnostics(df: DataFrame, n: int = 5) -> DataFrame:
    """Terms of each drop reason and its first different ones by name."""
    rows = df.where(F.col("auto_drop_reasons") != "").withColumn("reason", F.explode(F.split("auto_drop_reasons", "\\|")))
    named = top_n(rows.groupBy("reason", "term").agg(F.count("*").alias("_n")), ["reason"], [F.col("term").asc()], n, "_r")
    return rows.groupBy("reason").agg(F.count("*").alias("term_count")).join(named.groupBy("reason").agg(ordered_terms("term", "_r", n, " / ").alias("sample_terms")), "reason")


def coding_template(overall: DataFrame, single: DataFrame, manual: Sequence[str] = ("manual_keep", "manual_theme", "manual_context", "manual_note", "coder")) -> DataFrame:
    """Both shortlists, each (keyword, period, term) once, the overall list first, and blank columns to fill by hand."""
    both = overall.withColumn("_source", F.lit(0)).unionByName(single.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["keyword", "period_label", "term"], ["_source", "shortlist_rank"]).drop("_source").withColumns({c: F.lit("") for c in manual})


def override_template(overall: DataFrame, single: DataFrame) -> DataFrame:
    """Each (keyword, period, term) of both shortlists once, the overall list first, with its buckets and blank columns for hand-made rules.

    Columns that the lists don't have are left out.
    """
    both = overall.withColumn("_source", F.lit(0)).unionByName(single.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    rows = keep_first(both, ["keyword", "period_label", "term"], ["_source", "shortlist_rank"])
    blank = ("override_context_bucket", "override_theme_bucket", "enabled", "note")
    order = ("keyword", "period_label", "term", "auto_context_bucket", "context_bucket", "override_context_bucket", "auto_theme_bucket", "theme_bucket", "override_theme_bucket", "enabled", "note", "example_1_text")
    return rows.select(*[F.lit("").alias(c) if c in blank else F.col(c) for c in order if c in blank or c in rows.columns])


def midterm_counters(candidates: DataFrame, tables: dict[str, DataFrame], noise_terms: int = 0, overrides: int = 0) -> DataFrame:
    """One row: rows of the candidates, of those kept, and of each table as <name>_row_count; sizes of the hand-made lists."""
    out = candidates.agg(F.count("*").alias("candidate_row_count"), F.count_if("auto_keep_for_midterm").alias("auto_keep_row_count"))
    for name, df in tables.items():
        out = out.crossJoin(df.agg(F.count("*").alias(f"{name}_row_count")))  # one row each
    return out.withColumns({"exact_noise_term_count": F.lit(noise_terms), "bucket_override_count": F.lit(overrides)})


def summary_counters(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("candidate_rows"), F.count_if(F.col("auto_noise_flag")).alias("noise_rows"), F.count_if(F.col("auto_keep_for_midterm")).alias("kept_rows"),
        F.count_if(F.col("semantic_supported")).alias("semantic_rows"), F.count_if(F.col("low_specificity_flag")).alias("low_specificity_rows"), F.count_if(F.col("period_label") == "ALL").alias("overall_rows"),
    )
