"""Tables of reports put together from those of other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import focus
from .evaluation import error_summary, metric_rows, metrics


def top_table(overview: DataFrame, n: int = 15) -> DataFrame:
    """The n largest macro topics, numbers as text; shares in percent."""
    rows = overview.orderBy(F.col("doc_n").desc(), F.col("macro_topic").asc()).limit(n)
    percent = lambda c: F.concat(F.format_number(c, 2), F.lit("%"))
    return rows.select("macro_topic", "report_action", "topic_n", F.format_number("doc_n", 0).alias("docs"), percent(F.col("share_of_clustered_docs_pct")).alias("share"), "peak_period", percent(F.col("peak_doc_share") * 100).alias("peak_share"))


def combined_predictions(frames: dict[str, DataFrame], label: str = "label_standard") -> DataFrame:
    """Predictions of several label standards under each other; errors are those of is_error."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def run_bundle(judged: DataFrame, label: str = "label_standard", source: str = "source") -> dict[str, DataFrame]:
    """Metrics, metric rows, error summary and what to look at of each label standard of one run."""
    scored = metrics(judged, [label])
    return {
        "metrics": scored, "metric_rows": metric_rows(scored, [label]), "error_summary": error_summary(judged, source),
        "triage": scored.select(label, "f1", "precision", "recall", focus(F.col("precision"), F.col("recall"), F.col("f1")).alias("focus")),
    }


def scorecard(runs: dict[str, DataFrame], keys: Sequence[str] = ("label_standard",)) -> DataFrame:
    """Metric rows of several experiments, best first in each label and metric."""
    out = None
    for name, df in runs.items():
        part = metric_rows(df, keys).withColumn("experiment", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(*keys, "metric", F.col("value").desc(), "experiment")


def written_back(rows: DataFrame, results: DataFrame, key: str, outputs: Sequence[str]) -> DataFrame:
    """`rows` with results by key; those without one have nulls."""
    return rows.drop(*outputs).join(results.select(key, *outputs), key, "left")
