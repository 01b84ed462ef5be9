"""Column functions on text: cleaning, normalisers, tokens. All but the emoji names are Spark's own expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Alias lists and vocabularies that results depend on.
NULL_WORDS = ["nan", "none", "null", "na"]
NULL_REGIONS = ["nan", "none", "null", "na", "n/a", "unknown", "未知", "未显示", "-", "--"]
POSITIVE = ["1", "1.0", "true", "yes", "y", "relevant", "positive", "相关", "有关"]
NEGATIVE = ["0", "0.0", "false", "no", "n", "irrelevant", "negative", "无关", "不相关"]
NEGATIVE_TWO = ["2", "2.0"]
MODEL_LABELS = {"相关": ["相关", "有关", "有关系", "是", "yes", "true", "1"], "无关": ["无关", "不相关", "没关系", "否", "no", "false", "0"]}
CONFIDENCES = {"高": ["高", "高置信", "high", "h"], "中": ["中", "中等", "中置信", "medium", "med", "m"], "低": ["低", "低置信", "low", "l"]}
EXCLUSIONS = {
    "无": ["无"],
    "字面提及躺平": ["字面提及躺平", "字面提及", "躺下休息", "动作描写"],
    "明星粉圈": ["明星粉圈", "粉圈明星", "粉圈", "饭圈"],
    "游戏二次元": ["游戏二次元", "小说游戏二次元", "游戏", "二次元"],
    "鸡汤口号": ["鸡汤口号", "口号", "表情包"],
    "宠物日常": ["宠物日常", "宠物"],
    "广告与推广": ["广告与推广", "广告推广", "营销推广", "广告"],
    "正文未提躺平": ["正文未提躺平", "正文未提", "仅关键词命中", "仅话题命中"],
    "其他": ["其他"],
}
# in this order: the first that the value contains decides
EXCLUSION_PARTS = [
    ("字面提及躺平", ["字面", "躺下", "动作"]),
    ("明星粉圈", ["粉圈", "饭圈", "明星"]),
    ("游戏二次元", ["游戏", "二次元", "小说"]),
    ("鸡汤口号", ["口号", "鸡汤", "表情包"]),
    ("宠物日常", ["宠物"]),
    ("广告与推广", ["广告", "推广", "营销"]),
    ("正文未提躺平", ["正文未提", "仅话题", "仅关键词"]),
]
SPLIT_ALIASES = {"train": ["train", "training"], "val": ["val", "valid", "validation", "dev"], "test": ["test", "testing"]}
EMOJI = "\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FAFF}\\x{FE00}-\\x{FE0D}"
MODIFIERS = "\\x{FE0E}\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}"
SPACE = "[\\s\\x{1C}-\\x{1F}]"

Text = str | Column


def _c(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used: plain expressions are computed anew in every branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Text) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_c(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Text) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def font_table() -> tuple[str, str]:
    """Styled letters and digits, and the ASCII each stands for."""
    pairs = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
    for style in range(13):  # mathematical alphabets, capitals and small letters
        for k in range(26):
            pairs[chr(0x1D400 + 52 * style + k)] = chr(65 + k)
            pairs[chr(0x1D41A + 52 * style + k)] = chr(97 + k)
    for style in range(4):
        for k in range(10):
            pairs[chr(0x1D7CE + 10 * style + k)] = str(k)
    for k, raised in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹"):
        pairs[raised] = pairs[chr(0x2080 + k)] = str(k)
    return "".join(pairs), "".join(pairs.values())


def normalize_font(c: Text) -> Column:
    return F.translate(_c(c), *font_table())


def clean_post(c: Text) -> Column:
    """Post text without links, link captions, a trailing read-more mark or runs of white space; null becomes empty."""
    c = normalize_font(strip(F.coalesce(_c(c), F.lit(""))))
    for pattern in ("(?iU)https?://\\S+", f"(?U)L\\S*的微博视频{SPACE}*", f"(?U)网页链接{SPACE}*", f"(?U)全文{SPACE}*$"):
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def emoji_placeholder(c: Text) -> Column:
    """Each emoji with its modifiers as [emoji]; variation selectors elsewhere go."""
    c = F.regexp_replace(_c(c), f"[{EMOJI}][{MODIFIERS}]*", "[emoji]")
    return F.regexp_replace(c, "[\\x{FE0E}\\x{FE0F}]", "")


def emoji_names(c: Text) -> Column:
    """Each emoji as :its_unicode_name:, [emoji] if it has none. The one function that needs Python."""
    @F.pandas_udf(StringType())
    def named(texts: pd.Series) -> pd.Series:
        import re
        import unicodedata

        ranges = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), f"[{EMOJI}][{MODIFIERS}]*")
        pattern = re.compile(ranges)

        def name(m: re.Match) -> str:
            found = unicodedata.name(m[0][0], "").lower().replace(" ", "_")
            return f":{found}:" if found else "[emoji]"

        return texts.map(lambda t: None if t is None else re.sub("[\ufe0e\ufe0f]", "", pattern.sub(name, t)))

    return named(_c(c))


def text_hash(c: Text) -> Column:
    """MD5 of the text as hex; empty for a null or blank one."""
    return F.when(is_blank(c), "").otherwise(F.md5(_c(c).cast("binary")))


def _edges(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def normalize_keyword(c: Text) -> Column:
    """Keyword without URL escapes, white space, hash marks and brackets; null for blank and null-like words."""
    raw = _c(c).cast("string")
    text = strip(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    bare = F.regexp_replace(F.translate(text, "＃﹟", "##"), f"(?U){SPACE}+", "")
    bare = _edges(bare, "#%")
    bare = _edges(bare, "\\[\\]【】()（）<>《》\"'“”‘’")
    bare = strip(_edges(bare, "#%"))
    return F.when((text == "") | F.lower(text).isin(NULL_WORDS) | (bare == ""), F.lit(None)).otherwise(bare)


def keyword_list(keywords: Iterable[str]) -> list[str]:
    """Distinct keywords in order, without blank ones; an error if none is left."""
    found = list(dict.fromkeys(k.strip() for k in keywords if k and k.strip()))
    if not found:
        raise ValueError("no keywords")
    return found


def canonical_keyword(c: Text, allowed: Iterable[str]) -> Column:
    """The allowed keyword that the value is, or the only one it contains; else the normalised value."""
    value, allowed = normalize_keyword(c), keyword_list(allowed)
    inside = F.filter(F.array(*map(F.lit, allowed)), lambda k: F.contains(value, k))
    return F.when(value.isin(allowed), value).when(F.size(inside) == 1, F.get(inside, F.lit(0))).otherwise(value)


def normalize_region(c: Text) -> Column:
    """Region of an IP note without its prefix and punctuation; null for unknown ones."""
    text = strip(_c(c).cast("string"))
    bare = F.regexp_replace(text, "(?U)^(?:ip|IP)\\s*(?:属地|定位)?\\s*[:：]?\\s*", "")
    bare = _edges(bare, " ：:;；,，\\[\\]【】()（）<>《》\"'“”‘’")
    return F.when((text == "") | F.lower(text).isin(NULL_REGIONS) | (bare == ""), F.lit(None)).otherwise(bare)


def label_value(c: Text, two_is_negative: bool = True) -> Column:
    """1, 0 or null from numbers, booleans and words."""
    text = F.lower(strip(_c(c).cast("string")))
    negative = NEGATIVE + NEGATIVE_TWO * two_is_negative
    return F.when(text.isin(POSITIVE), 1).when(text.isin(negative), 0)


def _alias(text: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in table.items():
        out = F.when(text.isin(words), name).otherwise(out)
    return out


def _compact(c: Text) -> Column:
    return F.replace(F.lower(strip(_c(c).cast("string"))), F.lit(" "), F.lit(""))


def model_label(c: Text) -> Column:
    return _once(_compact(c), lambda text: _alias(text, MODEL_LABELS))


def model_confidence(c: Text) -> Column:
    return _once(_compact(c), lambda text: _alias(text, CONFIDENCES))


def exclusion_type(c: Text) -> Column:
    """Kind of an irrelevant post: by name, else by the first known part, else as it is; empty for null."""

    def kind(text: Column) -> Column:
        part = lambda compact: F.coalesce(*[F.when(compact.contains(w), name) for name, words in EXCLUSION_PARTS for w in words])
        return F.coalesce(_alias(text, EXCLUSIONS), _once(F.replace(text, F.lit(" "), F.lit("")), part), text)

    return _once(strip(F.coalesce(_c(c).cast("string"), F.lit(""))), kind)


def split_name(c: Text) -> Column:
    return _alias(F.lower(strip(_c(c).cast("string"))), SPLIT_ALIASES)


def truthy(c: Text) -> Column:
    return F.coalesce(F.lower(strip(_c(c).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def engagement(c: Text) -> Column:
    """Count in a text like 1,234 or 1.2万; 0 where there is none."""
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    return F.coalesce((number * F.when(text.contains("万"), 10_000).otherwise(1)).cast("long"), F.lit(0).cast("long"))


def preview(c: Text, limit: int = 120) -> Column:
    """White space folded, the first `limit` characters and ... where there are more."""
    text = strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"(?U){SPACE}+", " "))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate(c: Text, limit: int = 140) -> Column:
    """One line of at most `limit` characters, the last three ... where some are left out."""
    text = strip(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def shorten(c: Text, limit: int) -> Column:
    """First and last half of a text longer than `limit`."""
    head = limit // 2
    text = _c(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(limit - head)))).otherwise(text)


def slug(c: Text) -> Column:
    return _edges(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "-")


def tokens(c: Text, stopwords: Iterable[str] = (), least: int = 2) -> Column:
    """Lower-case tokens: ASCII words and CJK runs up to four characters whole, longer runs as overlapping pairs.

    Stop words, numbers, page marks like p12 and tokens under `least` characters are left out.
    """
    text = F.coalesce(_c(c), F.lit(""))
    # the pattern itself leaves out short words, numbers and page marks, which costs less than a look at each token
    word = f"(?![pP]?[0-9]+(?![A-Za-z0-9_]))[A-Za-z0-9_]{{{max(1, least)},}}"
    runs = F.regexp_extract_all(text, F.lit(f"{word}|[\\x{{4E00}}-\\x{{9FFF}}]+"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda k: F.substring(t, k, F.lit(2)))
    ascii_ = lambda t: t.rlike("^[A-Za-z0-9_]")
    split = F.filter(F.flatten(F.transform(runs, lambda t: F.when(ascii_(t) | (F.length(t) <= 4), F.array(t)).otherwise(pairs(t)))), lambda t: ascii_(t) | (F.length(t) >= least))
    found = F.transform(F.when(text.rlike("[\\x{4E00}-\\x{9FFF}]"), split).otherwise(runs), F.lower)
    stop = list(stopwords)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def tokens_from_text(c: Text) -> Column:
    """Tokens of a list written as text, like ['a', 'b']; a plain text is one token."""
    text = strip(F.coalesce(_c(c), F.lit("")))
    inner = F.regexp_replace(text, "^\\[|\\]$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda t: _edges(strip(t), "'\"")), lambda t: t != "")
    return F.when(text == "", F.array().cast(ArrayType(StringType()))).when(text.startswith("["), parts).otherwise(F.array(text))


def mended_json(c: Text) -> Column:
    """The outermost object of a model's answer: no code fences, straight quotes, no trailing commas; single quotes only where needed."""
    text = F.regexp_replace(strip(F.coalesce(_c(c), F.lit(""))), "(?i)```(?:json)?", "")
    text = F.translate(text, "“”‘’", "\"\"''")
    commas = lambda t: F.regexp_replace(t, ",\\s*([}\\]])", "$1")
    outermost = lambda t: _once(F.regexp_extract(t, "(?s)\\{.*\\}", 0), lambda inner: F.when(inner != "", inner).otherwise(t))
    mended = lambda t: F.when(F.try_parse_json(t).isNotNull(), t).otherwise(commas(F.regexp_replace(t, "(?<!\\\\)'", '"')))
    return _once(text, lambda t: _once(commas(outermost(t)), mended))


def checked_answer(c: Text) -> Column:
    """A model's answer as a struct: ok, label, exclusion, confidence, reason, problem.

    Label and confidence are required. A relevant post has no exclusion; an irrelevant one must have a known kind.
    """

    def read(json: Column) -> Column:
        parsed = F.from_json(json, "tangping_related_label string, confidence string, exclusion_type string, reason string")
        return F.struct((F.try_parse_json(json).isNotNull() & parsed.isNotNull()).alias("object"), parsed.alias("parsed"))

    def named(a: Column) -> Column:
        parsed = a["parsed"]
        reason = F.substring(strip(F.coalesce(parsed["reason"], F.lit(""))), 1, 20)
        return F.struct(a["object"].alias("object"), model_label(parsed["tangping_related_label"]).alias("label"), model_confidence(parsed["confidence"]).alias("confidence"), exclusion_type(parsed["exclusion_type"]).alias("kind"), reason.alias("reason"))

    def checked(a: Column) -> Column:
        known = a["kind"].isin([k for k in EXCLUSIONS if k != "无"])
        problem = F.when(~a["object"], "not_object").when(a["label"].isNull(), "invalid_label").when(a["confidence"].isNull(), "invalid_confidence")
        problem = F.coalesce(problem, F.when((a["label"] == "无关") & ~known, "invalid_exclusion_for_irrelevant"), F.lit(""))
        exclusion = F.when(a["label"] == "相关", "无").when(known, a["kind"]).otherwise("其他")
        return F.struct((problem == "").alias("ok"), a["label"].alias("label"), exclusion.alias("exclusion"), a["confidence"].alias("confidence"), a["reason"].alias("reason"), problem.alias("problem"))

    return _once(mended_json(c), lambda json: _once(read(json), lambda a: _once(named(a), checked)))


def first_bucket(c: Text, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule one of whose markers the lower-case text contains."""
    text = F.lower(F.coalesce(_c(c), F.lit("")))
    hits = [F.when(F.greatest(*[F.contains(text, F.lit(m.lower())) for m in markers]) if len(markers) > 1 else F.contains(text, F.lit(markers[0].lower())), name) for name, markers in rules if markers]
    return F.coalesce(*hits, F.lit(default))


def read_rules(text: str, kind: str) -> list[tuple[str, list[str]]]:
    """Ordered rules of one kind from a JSON document {kind: [{bucket, markers}]}."""
    return [(r["bucket"], [m for m in r["markers"] if m.strip()]) for r in json.loads(text).get(kind, [])]
