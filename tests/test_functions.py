import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text


def values(spark, rows, f):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("x"))).collect()]


def check(spark, f, cases):
    assert values(spark, [c[0] for c in cases], f) == [c[1] for c in cases]


def test_cleaner(spark):
    check(spark, text.clean_post, [("https://t.cn/x　后文", "后文"), ("HTTP://a.b rest", "rest"), ("L某某的微博视频 正文", "正文"), ("网页链接 a", "a"), ("正文 全文 ", "正文"), ("ＡＢＣ１２", "ABC12"), ("𝐀𝟗", "A9"), ("x²₃", "x23"), ("a　　 b\t\nc", "a b c"), ("https://only", ""), (None, "")])


def test_emoji(spark):
    cases = [("😀", "[emoji]"), ("👍🏽!", "[emoji]!"), ("☀️", "[emoji]"), ("a️b", "ab"), ("👩‍👧", "[emoji]‍[emoji]"), ("🇨🇳", "🇨🇳"), ("plain", "plain")]
    check(spark, text.emoji_placeholder, cases)
    check(spark, text.emoji_names, [("😀x", ":grinning_face:x"), ("👍🏽", ":thumbs_up_sign:"), ("☀️", ":black_sun_with_rays:"), (None, None)])


def test_keywords(spark):
    cases = [("#躺平#", "躺平"), ("＃摆烂﹟", "摆烂"), ("%E8%BA%BA%E5%B9%B3", "躺平"), ("佛 系", "佛系"), ("【躺平】", "躺平"), ("nan", None), ("100%", "100"), (" ", None), (None, None), ("a+b", "a+b")]
    check(spark, text.normalize_keyword, cases)
    allowed = ["躺平", "摆烂", "佛系"]
    check(spark, lambda c: text.canonical_keyword(c, allowed), [("躺平和摆烂", "躺平和摆烂"), ("躺平学", "躺平"), ("佛系", "佛系"), ("x", "x"), ("null", None)])
    assert text.keyword_list([" a ", "b", "a", ""]) == ["a", "b"]
    with pytest.raises(ValueError):
        text.keyword_list([" "])


def test_regions_labels_splits(spark):
    check(spark, text.normalize_region, [("IP属地：北京", "北京"), ("ip 上海", "上海"), ("未知", None), ("--", None), (None, None), ("广东", "广东")])
    check(spark, text.label_value, [("1", 1), ("1.0", 1), ("True", 1), ("相关", 1), ("2", 0), ("", None), ("maybe", None), ("No", 0), (None, None)])
    check(spark, lambda c: text.label_value(c, False), [("2", None), ("0", 0)])
    check(spark, text.split_name, [("Training", "train"), (" dev ", "val"), ("TEST", "test"), ("x", None)])
    check(spark, text.exclusion_type, [("粉圈", "明星粉圈"), ("很 多游戏", "游戏二次元"), ("新类", "新类"), (None, "")])
    check(spark, text.truthy, [("Yes", True), ("0", False), (None, False)])


def test_numbers_and_previews(spark):
    check(spark, text.engagement, [("1.2万", 12000), ("1,234", 1234), ("", 0), (None, 0), ("赞 7", 7), ("none", 0)])
    check(spark, lambda c: text.preview(c, 5), [("a  b\nc", "a b c"), ("abcdefg", "abcde..."), (None, "")])
    check(spark, lambda c: text.truncate(c, 6), [("abcdef", "abcdef"), ("abcdefg", "abc..."), ("a\nb", "a b")])
    check(spark, lambda c: text.shorten(c, 4), [("abcd", "abcd"), ("abcdefgh", "ab … gh")])
    check(spark, text.slug, [("A b/c!", "a-b-c")])


def test_tokens(spark):
    check(spark, text.tokens, [("躺平生活真好呀 p12 123 Ok a", ["躺平", "平生", "生活", "活真", "真好", "好呀", "ok"]), ("四个字的 x_1", ["四个字的", "x_1"]), (None, [])])
    check(spark, lambda c: text.tokens(c, ["the"]), [("The THE cat", ["cat"])])
    check(spark, text.tokens_from_text, [("['a', \"b\", ]", ["a", "b"]), ("word", ["word"]), ("", []), (None, [])])


def test_answers(spark):
    answers = [
        '```json\n{"tangping_related_label": "相关", "confidence": "High", "exclusion_type": "游戏",}\n```', "prose {'tangping_related_label': '否', 'confidence': '中', 'exclusion_type': '饭圈文化'} tail",
        "{“tangping_related_label”: “无关”, “confidence”: “低”, “exclusion_type”: “别的”}", '{"confidence": "高"}', "nothing", None,
    ]
    got = values(spark, answers, text.checked_answer)
    assert [(r["ok"], r["label"], r["exclusion"], r["problem"]) for r in got] == [
        (True, "相关", "无", ""), (True, "无关", "明星粉圈", ""), (False, "无关", "其他", "invalid_exclusion_for_irrelevant"), (False, None, "其他", "invalid_label"), (False, None, "其他", "not_object"), (False, None, "其他", "not_object"),
    ]


def test_buckets(spark):
    rules = text.read_rules('{"theme_buckets": [{"bucket": "money", "markers": ["ETF", "fund"]}, {"bucket": "work", "markers": ["job", "fund"]}]}', "theme_buckets")
    check(spark, lambda c: text.first_bucket(c, rules, "other"), [("an etf", "money"), ("Job", "work"), ("fund", "money"), ("x", "other"), (None, "other")])


def test_periods(spark):
    check(spark, lambda c: stats.period(stats.timestamp(c), "quarter"), [("2024-05-01 10:00", "2024Q2"), ("2024/1/5", "2024Q1"), ("2024-1-5", "2024Q1"), ("bad", "NA"), (None, "NA")])
    check(spark, lambda c: stats.period(stats.timestamp(c), "month", None), [("2024-05-01", "2024-05"), (None, None)])
    check(spark, lambda c: stats.length_bin(F.length(c)), [("x" * 20, "<=20"), ("x" * 21, "21-60"), ("x" * 140, "61-140"), ("x" * 141, ">140")])


def test_divergence_and_cosine(spark):
    rows = [("same", 0.5, 0.5), ("same", 0.5, 0.5), ("apart", 1.0, None), ("apart", None, 1.0)]
    got = {r["g"]: r["js"] for r in spark.createDataFrame(rows, "g string, p double, q double").groupBy("g").agg(stats.js_divergence(F.col("p"), F.col("q")).alias("js")).collect()}
    assert got == {"same": 0.0, "apart": 1.0}
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(stats.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None]
