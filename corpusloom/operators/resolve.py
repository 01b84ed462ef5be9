"""Columns by candidate names, and projections to a fixed schema. All but the data-dependent two read the schema only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, label_value

# Names tried in this order.
TEXTS = ["cleaned_text", "cleaned_text_with_emoji", "text_raw", "微博正文", "text", "content", "body", "message", "post_text", "desc", "description", "title"]
TIMES = ["publish_time", "发布时间", "created_at", "timestamp"]
KEYWORDS = ["keyword_normalized", "keyword", "hit_keyword", "query_keyword"]
REGIONS = ["ip_normalized", "ip", "IP", "ip_location", "IP属地"]
LABELS = ["label", "tangping_related", "tangping_related_label", "broad", "strict"]
NEVER_TEXT = ["发布时间", "created_at", "publish_time", "timestamp", "keyword", "hit_keyword", "query_keyword", "id", "mid", "话题", "转发数", "评论数", "点赞数", "ip", "source_file", "label", "label_text", "label_raw", "tangping_related", "tangping_related_label"]


def resolve(df: DataFrame, candidates: Sequence[str], forced: str | None = None, what: str = "column") -> str:
    """The forced column, which must exist, or the first candidate that does. An empty name forces nothing."""
    if forced:
        if forced not in df.columns:
            raise ValueError(f"no {what} {forced}; there are {df.columns}")
        return forced
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} among {list(candidates)}; there are {df.columns}")


def resolve_text(df: DataFrame, forced: str | None = None) -> str:
    """As `resolve`; without a candidate, the string column with most texts, the first of equals."""
    if forced or any(c in df.columns for c in TEXTS):
        return resolve(df, TEXTS, forced, "text column")
    strings = [c for c, kind in df.dtypes if kind == "string" and c not in NEVER_TEXT]
    if not strings:
        raise ValueError("no text column")
    filled = df.agg(*[F.count_if(~is_blank(F.col(f"`{c}`"))).alias(c) for c in strings]).first()
    best = max(strings, key=lambda c: (filled[c], -strings.index(c)))
    if not filled[best]:
        raise ValueError("no text column with texts")
    return best


def resolve_label(df: DataFrame, candidates: Iterable[str] = LABELS, forced: str | None = None, two_is_negative: bool = True) -> str:
    """The candidate most of whose values are labels, the first of equals; an error if none has a label at all."""
    names = [c for c in candidates if c in df.columns]
    if forced or not names:
        return resolve(df, list(candidates), forced, "label column")
    good = df.agg(*[F.count(label_value(F.col(f"`{c}`"), two_is_negative)).alias(c) for c in names]).first()
    best = max(names, key=lambda c: (good[c], -names.index(c)))
    if not good[best]:
        raise ValueError(f"none of {names} holds a label")
    return best


def first_with_values(df: DataFrame, candidates: Sequence[str], usable) -> str | None:
    """The first candidate column that has a value for which `usable(column)` is true: one aggregate over all."""
    names = [c for c in candidates if c in df.columns]
    if not names:
        return None
    found = df.agg(*[F.bool_or(F.coalesce(usable(F.col(f"`{c}`")), F.lit(False))).alias(c) for c in names]).first()
    return next((c for c in names if found[c]), None)


def to_schema(df: DataFrame, columns: Sequence[str], constants: dict[str, str] | None = None) -> DataFrame:
    """Exactly `columns` in that order, all text: constants, what is there, or empty."""
    constants = constants or {}
    pick = lambda c: F.lit(constants[c]) if c in constants else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(*[pick(c).alias(c) for c in columns])


def unique_headers(names: Sequence[str | None], first: int = 1) -> list[str]:
    """Header cells made distinct: blank ones are unnamed_1 and so on, counted from `first`, repeats get __2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for k, raw in enumerate(names, first):
        name = (raw or "").strip() or f"unnamed_{k}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return out


def drop_if_there(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)
