"""Column functions on numbers, vectors and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "yyyy/M/d", "yyyy-M-d HH:mm", "yyyyMMdd"]
MISSING_PERIOD = "NA"
PERIODS = ("month", "quarter", "year")


def timestamp(c: str | Column) -> Column:
    """Timestamps of any of the accepted formats; null where none fits."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def period(ts: Column, granularity: str = "month", missing: str | None = MISSING_PERIOD) -> Column:
    """2024-05, 2024Q2 or 2024 of a timestamp."""
    if granularity not in PERIODS:
        raise ValueError(f"granularity must be one of {PERIODS}")
    year = F.date_format(ts, "yyyy")
    label = {"month": F.date_format(ts, "yyyy-MM"), "quarter": F.concat(year, F.lit("Q"), F.quarter(ts).cast("string")), "year": year}[granularity]
    return label if missing is None else F.coalesce(label, F.lit(missing))


def length_bin(chars: Column) -> Column:
    return F.when(chars <= 20, "<=20").when(chars <= 60, "21-60").when(chars <= 140, "61-140").otherwise(">140")


def pmi(joint: Column, total: Column, part: Column, reference: Column) -> Column:
    """log2(joint * total / (part * reference)): how much more often than by chance."""
    return F.log2(joint.cast("double") * total / (part.cast("double") * reference))


def lift(joint: Column, total: Column, part: Column, reference: Column) -> Column:
    """Rate in the part over the rate in all."""
    return (joint.cast("double") / part) / (reference.cast("double") / total)


def midterm_score(freq: Column, lift_: Column, similarity: Column) -> Column:
    return F.log1p(freq.cast("double")) * lift_ * (F.lit(1.0) + F.greatest(F.coalesce(similarity.cast("double"), F.lit(0.0)), F.lit(0.0)))


def js_divergence(p: Column, q: Column) -> Column:
    """Aggregate: base-2 Jensen-Shannon divergence of two aligned columns of weights, from their shares p and q.

    Both must be shares already (nulls count as 0). A share that isn't positive adds nothing, as where weights are scores of
    either sign; null where a positive share meets one so negative that their mean isn't positive.
    """
    p, q = F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
    mid = (p + q) / 2
    part = lambda x: F.when((x > 0) & (mid > 0), x * F.log2(x / mid)).otherwise(0.0)
    total = F.sum(part(p) + part(q)) / 2
    total = F.when((total < 0) & (total > -1e-9), 0.0).otherwise(total)  # rounding
    return F.when(~F.bool_or((F.greatest(p, q) > 0) & (mid <= 0)), total)


def cosine(a: Column, b: Column) -> Column:
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def focus(precision: Column, recall: Column, f1: Column) -> Column:
    """What to look at in a classifier: nothing, missed positives, false alarms or both."""
    return F.when(f1 >= 0.85, "overall_ok").when(recall + 0.08 < precision, "recall_low").when(precision + 0.08 < recall, "precision_low").otherwise("mixed_errors")
