"""Labels and predictions: frames, metrics and error reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import focus
from ..functions.text import is_blank, label_value, preview
from .ranking import first_of

LABEL_TEXT = {1: "相关", 0: "无关"}


def label_text(c: Column) -> Column:
    return F.when(c == 1, LABEL_TEXT[1]).when(c == 0, LABEL_TEXT[0])


def normalised_labels(df: DataFrame, column: str, two_is_negative: bool = True) -> DataFrame:
    """Adds label_raw, label and label_text."""
    return df.withColumn("label_raw", F.col(column).cast("string")).withColumn("label", label_value(column, two_is_negative)).withColumn("label_text", label_text(F.col("label")))


def require_labels(df: DataFrame, column: str = "label", raw: str = "label_raw", shown: int = 10) -> DataFrame:
    """`df`, or an error that names some of the values that are no labels."""
    bad = [r[0] for r in df.where(F.col(column).isNull()).select(raw).distinct().orderBy(raw).limit(shown).collect()]
    if bad:
        raise ValueError(f"no labels: {bad}")
    return df


def labelled_frame(df: DataFrame, text: str, labels: dict[str, str], require_all: bool = True) -> DataFrame:
    """Trimmed text and 0/1 labels under new names (name: column), without rows of blank text or missing labels."""
    out = df.withColumn("text", F.trim(F.col(text))).withColumns({name: label_value(F.col(c)) for name, c in labels.items()})
    return out.where(~is_blank("text")).na.drop(subset=list(labels), how="any" if require_all else "all")


def predictions(df: DataFrame, probability: str, threshold: float = 0.5, model: str = "") -> DataFrame:
    p = F.col(probability).cast("double")
    out = df.withColumn("pred_label", F.when(p >= threshold, 1).when(p.isNotNull(), 0)).withColumn("pred_prob_1", p).withColumn("pred_prob_0", 1 - p)
    return out.withColumn("pred_label_text", label_text(F.col("pred_label"))).withColumn("pred_confidence", F.greatest("pred_prob_1", "pred_prob_0")).withColumn("model_dir", F.lit(model))


def judged(df: DataFrame, gold: str = "gold_label") -> DataFrame:
    """Adds is_error and error_type: FN, FP or empty."""
    g, p = F.col(gold), F.col("pred_label")
    out = df.withColumn("is_error", F.coalesce(g != p, F.lit(False)))
    return out.withColumn("error_type", F.when((g == 1) & (p == 0), "FN").when((g == 0) & (p == 1), "FP").otherwise(""))


def metrics(df: DataFrame, groups: Sequence[str] = (), gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; a ratio of nothing is 0."""
    g, p = F.col(gold), F.col(pred)
    out = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if((g == 1) & (p == 1)).alias("tp"), F.count_if((g == 0) & (p == 1)).alias("fp"), F.count_if((g == 1) & (p == 0)).alias("fn"), F.count_if((g == 0) & (p == 0)).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    c = F.col
    return out.withColumns({
        "accuracy": ratio(c("tp") + c("tn"), c("n")), "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "f1": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
    })


def error_summary(df: DataFrame, source: str = "source") -> DataFrame:
    """Errors by type with their mean confidence, and by source and type."""
    wrong = df.where("is_error")
    one = wrong.groupBy("error_type").agg(F.count("*").alias("errors"), F.avg("pred_confidence").alias("mean_confidence")).select(F.lit("error_type").alias("level"), F.lit("").alias("source"), "error_type", "errors", "mean_confidence")
    two = wrong.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), "error_type").agg(F.count("*").alias("errors"), F.avg("pred_confidence").alias("mean_confidence"))
    return one.unionByName(two.select(F.lit("source").alias("level"), "source", "error_type", "errors", "mean_confidence"))


def ranked_errors(df: DataFrame, n: int = 200, kind: str | None = None, tie: str = "doc_id") -> DataFrame:
    """The n most confident errors, of one type or all, with a preview where there is a text."""
    rows = df.where(F.col("is_error") if kind is None else F.col("error_type") == kind).orderBy(F.col("pred_confidence").desc(), F.col(tie).asc()).limit(n)
    return rows.withColumn("text_preview", preview("text")) if "text" in df.columns else rows


def side_by_side(base: DataFrame, first: DataFrame, second: DataFrame, key: str, names: tuple[str, str] = ("broad", "strict")) -> DataFrame:
    """Base rows with both models' columns under prefixes, and which of them err."""
    prefix = lambda df, name: df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
    out = base.join(prefix(first, names[0]), key).join(prefix(second, names[1]), key)
    a, b = F.col(f"{names[0]}_is_error"), F.col(f"{names[1]}_is_error")
    return out.withColumn("error_bucket", F.when(a & b, "both_wrong").when(a, f"{names[0]}_only_wrong").when(b, f"{names[1]}_only_wrong").otherwise("both_correct"))


def diagnosis(test: DataFrame, validation: DataFrame, errors: DataFrame, label: str = "label_standard") -> DataFrame:
    """Of each label standard: test metrics, its most frequent error (ties by name), validation F1 and what to look at."""
    wrong = errors.where("is_error").groupBy(label, "error_type").agg(F.count("*").alias("dominant_error_count"))
    main = first_of(wrong, [label], [F.col("dominant_error_count").desc(), F.col("error_type").asc()]).withColumnRenamed("error_type", "dominant_error")
    out = test.join(main, label, "left").join(validation.select(label, F.col("f1").alias("validation_f1")), label, "left").na.fill({"dominant_error": "", "dominant_error_count": 0})
    out = out.withColumn("focus", focus(F.col("precision"), F.col("recall"), F.col("f1")))
    file = F.when(F.col("focus") == "recall_low", "errors_fn").when(F.col("focus") == "precision_low", "errors_fp").otherwise("errors_ranked")
    return out.withColumn("suggested_file", file).withColumn("f1_gap", F.col("validation_f1") - F.col("f1"))


def metric_rows(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """One row for each metric of each of `keys`."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("_m")).select(*keys, "_m.metric", "_m.value")


def auc_by_rank(df: DataFrame, gold: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from counts of each score."""
    counts = df.groupBy(*groups, score).agg(F.count_if(F.col(gold) == 1).alias("_p"), F.count_if(F.col(gold) == 0).alias("_n"))
    below = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = counts.withColumn("_w", F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2))
    return won.groupBy(*groups).agg(F.try_divide(F.sum("_w"), F.sum("_p").cast("double") * F.sum("_n")).alias("auc"))
