"""The analysis base: predicted posts with time, region and keyword in normal form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import period, timestamp
from ..functions.text import canonical_keyword, is_blank, normalize_region
from ..operators.resolve import KEYWORDS, REGIONS, TIMES, resolve, resolve_text

DEFAULT_KEYWORDS = ("躺平", "摆烂", "佛系")
MISSING_REGION = "UNKNOWN_IP"


def with_time(df: DataFrame, time_col: str) -> DataFrame:
    ts = timestamp(time_col)
    out = df.withColumn("publish_time", ts)
    t = F.col("publish_time")
    return out.withColumns({"year": F.year(t).cast("long"), "year_month": period(t, "month", None), "year_quarter": period(t, "quarter", None), "year_only": period(t, "year", None)})


def with_region(df: DataFrame, region_col: str) -> DataFrame:
    out = df.withColumn("ip_raw", F.col(region_col).cast("string")).withColumn("_r", normalize_region(region_col))
    return out.withColumn("ip_missing", F.col("_r").isNull()).withColumn("ip_normalized", F.coalesce("_r", F.lit(MISSING_REGION))).drop("_r")


def analysis_base(df: DataFrame, keywords: Sequence[str] = DEFAULT_KEYWORDS, positive_only: bool = True, min_confidence: float | None = None, label: str = "pred_label", text: str | None = None) -> DataFrame:
    """Rows with a text, an allowed keyword, enough confidence and, if asked, a positive prediction, with all derived columns."""
    text = resolve_text(df, text)
    out = with_region(with_time(df, resolve(df, TIMES)), resolve(df, REGIONS))
    key = resolve(df, KEYWORDS)
    out = out.withColumn("analysis_text", F.trim(F.coalesce(F.col(text), F.lit("")))).withColumn("keyword_raw", F.col(key)).withColumn("keyword_normalized", canonical_keyword(key, keywords))
    out = out.withColumn("keyword_in_scope", F.coalesce(F.col("keyword_normalized").isin(list(keywords)), F.lit(False)))
    out = out.withColumn("is_positive_prediction", F.coalesce(F.col(label).cast("string").try_cast("double").cast("int") == 1, F.lit(False)))
    score = next((c for c in ("pred_prob_1", "pred_confidence") if c in df.columns), None)
    passes = F.lit(True) if min_confidence is None or score is None else F.coalesce(F.col(score).cast("string").try_cast("double") >= min_confidence, F.lit(False))
    out = out.withColumn("passes_min_confidence", passes)
    kept = ~is_blank("analysis_text") & F.col("keyword_in_scope") & F.col("passes_min_confidence")
    return out.where(kept & F.col("is_positive_prediction") if positive_only else kept)


def before_month_end(df: DataFrame, month: str, ts: str = "publish_time") -> DataFrame:
    """Rows up to the end of a month like 2024-05."""
    return df.where(F.col(ts) < F.add_months(F.to_date(F.lit(month + "-01")), 1))


def up_to_period(df: DataFrame, last: str, column: str = "period_label") -> DataFrame:
    return df.where(F.col(column) <= last)


def without_periods(df: DataFrame, periods: Sequence[str], column: str = "period_label") -> DataFrame:
    return df.where(~F.col(column).isin(list(periods)))
