import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import dedup, drift, evaluation, macro, merge, resolve, sampling, shares
from corpusloom.sources import files


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 80), min_size=1, max_size=9), st.integers(1, 60), st.integers(0, 30))
def test_allocation(counts, n, least):
    total, promised = sum(counts.values()), sum(c >= least > 0 for c in counts.values())
    if n > total or promised > n:
        with pytest.raises(ValueError):
            sampling.allocate(counts, n, least)
        return
    take = sampling.allocate(counts, n, least)
    assert sum(take.values()) == n and all(int(0 < least <= counts[s]) <= k <= counts[s] for s, k in take.items())


def test_allocation_example():
    assert sampling.allocate({"a": 100, "b": 50, "c": 3}, 10) == {"a": 7, "b": 3, "c": 0}
    assert sampling.allocate({"a": 100, "b": 50, "c": 3}, 10, 3) == {"a": 6, "b": 3, "c": 1}


def test_split_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(200)], "id long, label int")
    a = {r["id"]: r["split"] for r in sampling.split(df, "id", "label", 0.1, 0.2).collect()}
    assert a == {r["id"]: r["split"] for r in sampling.split(df.repartition(7), "id", "label", 0.1, 0.2).collect()}
    for label in (0, 1):
        own = [s for k, s in a.items() if k % 2 == label]
        assert (own.count("val"), own.count("test"), own.count("train")) == (10, 20, 70)
    rare = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0)], "id long, a int, b int")
    assert sampling.split_with_fallback(rare.withColumn("a", F.col("id")), "id", ["a", "b"])[1] == "b"
    with pytest.raises(ValueError):
        sampling.predefined_split(spark.createDataFrame([("train",), ("odd",)], "part string"), "part")


def test_row_ids(spark):
    got = sampling.row_ids(spark.range(500), ["id"]).collect()
    assert sorted(r["row_id"] for r in got) == list(range(500))


def test_dedup(spark):
    rows = [(" 1 ", "b", 2), ("1", "a", 1), ("", "x", 3), (None, "y", 4), ("2", "z", 5), ("3", "w", 6)]
    df = spark.createDataFrame(rows, "id string, text string, pos int")
    seen = df.where("id = '3'").select(F.md5("id").alias("h"))
    new, counts, hashes = dedup.dedup_by_id(df, seen, ["pos"])
    assert sorted((r["id"], r["text"]) for r in new.collect()) == [("1", "a"), ("2", "z")] and hashes.count() == 2
    assert counts.first().asDict() == {"incoming_rows": 6, "missing_id_rows": 2, "batch_dedup_removed": 1, "existing_dedup_removed": 1, "appended_rows": 2}
    assert dedup.fingerprint(df).first() == dedup.fingerprint(df.repartition(3)).first() != dedup.fingerprint(df.limit(5)).first()


def test_resolution(spark):
    df = spark.createDataFrame([("a b", "1", None, " "), ("c", "no", "2", "x")], "words string, label string, broad string, id string")
    assert resolve.resolve_text(df) == "words" and resolve.resolve_label(df) == "label" and resolve.resolve(df, ["x", "id"]) == "id"
    with pytest.raises(ValueError):
        resolve.resolve(df, ["nothing"])
    assert resolve.unique_headers(["a", "", "a", None]) == ["a", "unnamed_2", "a__2", "unnamed_4"]
    assert resolve.to_schema(df, ["id", "new", "broad"], {"new": "k"}).first() == (" ", "k", "")


def test_drift_edges(spark):
    rows = [("k", "2024-01", "a", 1.0, 1), ("k", "2024-01", "b", 1.0, 2), ("k", "2024-02", "b", 1.0, 1), ("k", "2024-02", "c", -1.0, 2), ("k", "ALL", "z", 9.0, 1), ("k", "NA", "z", 9.0, 1)]
    got = drift.ranked_term_drift(spark.createDataFrame(rows, "keyword string, period_label string, term string, pmi double, term_rank int")).collect()
    assert [(r["overlap_count"], r["overlap_terms"], r["added_terms"], r["removed_terms"], r["js_divergence"]) for r in got] == [(1, "b", "c", "a", None)]
    assert got[0]["jaccard_top_terms"] == pytest.approx(1 / 3)


def test_share_family_matches_single_tables(spark):
    df = spark.createDataFrame([(k, p, r, t) for k in "xy" for p in "12" for r in "ab" for t in (0, 1, 1)], "keyword string, period_label string, region string, topic_id int")
    whole = shares.share_family(df)
    for level, groups in (("period", ["period_label"]), ("keyword_period_region", ["keyword", "period_label", "region"])):
        one = shares.topic_share(df, groups, label=None)
        assert sorted(map(tuple, whole.where(F.col("level") == level).select(*one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "g string, gold_label int, pred_label int")
    got = {r["g"]: (r["precision"], r["recall"], r["f1"], r["accuracy"]) for r in evaluation.metrics(df, ["g"]).collect()}
    assert got == {"a": (0.0, 0.0, 0.0, 1.0), "b": (0.0, 0.0, 0.0, 0.0)}
    with pytest.raises(ValueError, match="odd"):
        evaluation.require_labels(evaluation.normalised_labels(spark.createDataFrame([("odd",)], "x string"), "x"))


def test_macro_rules(spark):
    df = spark.createDataFrame([(1, "z"), (2, "Dream Job"), (3, "dream"), (4, "c.*"), (5, None)], "topic_id int, t string")
    got = macro.assign_macro(df, {1: ("one", "keep")}, [("work", "weak", ["job"]), ("odd", "omit", [".*"])], [("sleep", "weak", ["dream"])], ("other", "weak"), F.col("t")).orderBy("topic_id").collect()
    assert [(r["macro_topic"], r["merge_source"]) for r in got] == [("one", "manual"), ("work", "rule"), ("sleep", "fallback"), ("odd", "rule"), ("other", "fallback-other")]


def test_merge(spark):
    rows = [(0, 1, "7", "text", "k", "0", None), (1, 1, "7.0", "other", "k", "2", "1"), (1, 2, None, "new", None, "1", ""), (2, 1, "8", "123", None, None, None), (2, 2, "8", "words", None, None, None)]
    merged, conflicts = merge.merge_annotations(spark.createDataFrame(rows, "tab int, row int, id string, cleaned_text string, keyword string, broad string, strict string"), ["tab", "row"])
    got = {r["merge_key"]: (r["cleaned_text"], r["broad"], r["strict"]) for r in merged.collect()}
    assert got == {"id:7": ("text", "0", "1"), "text:new": ("new", "1", None), "id:8": ("words", None, None)}
    assert sorted((r["merge_key"], r["field"], r["value"]) for r in conflicts.collect()) == [("id:7", "cleaned_text", "other"), ("id:8", "cleaned_text", "123")]


def test_resume_matches_repeats(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    done = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3")], "x string, y string")
    assert sorted((r["x"], r["y"] or "") for r in dedup.resumed(rows, done, ["y"]).collect()) == [("a", "1"), ("a", "2"), ("b", "")]


def test_no_label_column(spark):
    df = spark.createDataFrame([("maybe", "?")], "label string, broad string")
    with pytest.raises(ValueError):
        resolve.resolve_label(df)
    assert resolve.resolve(df, ["label"], "") == "label"


@pytest.mark.parametrize(("value", "text"), [("1.5", True), ("12", False), ("a", False), ("ab", True), ("TRUE", False), ("false", False), ("-3", True), ("躺平", True), ("１２", False)])
def test_looks_like_text(spark, value, text):
    from corpusloom.operators.merge import looks_like_text

    assert spark.range(1).select(looks_like_text(F.lit(value)).alias("x")).first()["x"] == text


def test_divergence_of_scores_of_either_sign(spark):
    """As the plain sum over positive shares; null where their mean isn't positive or a period adds up to nothing."""
    import math

    def plain(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return sum(x * math.log2(x / ((x + y) / 2)) for side in ((p, q), (q, p)) for x, y in zip(*side, strict=True) if x > 0) / 2

    cases = {"plain": ([3.0, 1.0, 0.0], [1.0, 1.0, 2.0]), "negative": ([3.0, -0.5, 1.0], [2.0, 1.0, -0.2])}
    odd = {"mean": ([4.0, -3.0], [1.0, 0.5]), "nothing": ([1.0, -1.0], [1.0, 1.0])}
    terms = [(k, f"p{side}", t, float(s), n) for k, pair in (cases | odd).items() for side, scores in enumerate(pair) for n, (t, s) in enumerate(zip("abc", scores, strict=False))]
    df = spark.createDataFrame(terms, "keyword string, period_label string, term string, pmi double, term_rank int")
    got = {r["keyword"]: r["js_divergence"] for r in drift.ranked_term_drift(df).collect()}
    assert got["mean"] is None and got["nothing"] is None and all(abs(got[k] - plain(*v)) < 1e-9 for k, v in cases.items())


def test_a_pool_and_given_rows(spark):
    """Rows of the pool that are given are left out; parts come together by name; empty parts and unknown names are errors."""
    pool = spark.createDataFrame([(k, k % 2, "p", "x") for k in range(40)], "id long, label int, source string, more string")
    val = spark.createDataFrame([("v", 1, k) for k in range(100, 105)] + [("p", 0, 0), ("p", 1, 1)], "source string, label int, id long")
    out, report = sampling.assembled_split(pool, {"val": val}, "id", ["label"])
    assert report["pool_overlap_removed"] == 2 and report["split_strategy"] == "label" and sum(report["split_sizes"].values()) == 38 + 7 == out.count()
    assert report["source_breakdown"]["val"]["v"] == 5 and {r["id"] for r in out.where("split = 'val'").collect()} >= {0, 1, 100, 104}
    fixed, report = sampling.assembled_split(None, {"train": val, "val": val, "test": val}, "id", ["label"])
    assert report["split_strategy"] == "predefined_only" and fixed.count() == 21 and report["source_breakdown"]["test"] == {"p": 2, "v": 5}
    for bad in ({"pool": None, "explicit": {"train": val}}, {"pool": pool, "explicit": {"dev": val}}, {"pool": None, "explicit": {}}):
        with pytest.raises(ValueError):
            sampling.assembled_split(bad["pool"], bad["explicit"], "id", ["label"])


def test_labels_of_topics(spark):
    info = spark.createDataFrame([(0, " ", "0_a_b"), (1, "one", "n"), (2, None, "")], "topic_id int, topic_label_machine string, Name string")
    labels = shares.topic_labels(info)
    assert {r["topic_id"]: r["topic_label"] for r in labels.collect()} == {0: "0_a_b", 1: "one", 2: "Topic 2"}
    assert {r["topic_label"] for r in shares.topic_labels(info.select("topic_id")).collect()} == {"Topic 0", "Topic 1", "Topic 2"}
    docs = spark.createDataFrame([(1, -1), (2, 1)], "id long, topic_id int")
    assert {r["id"]: r["topic_label"] for r in shares.with_topic_labels(docs, labels).collect()} == {1: "Outlier", 2: "one"}


def test_vectors_of_other_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    rows = docs.selectExpr("id", "array(1.0) as vector")
    files.save_vectors(rows, str(tmp_path / "v"), docs)
    assert files.vectors(spark, str(tmp_path / "v"), docs.orderBy("text")).count() == 2
    with pytest.raises(ValueError):
        files.vectors(spark, str(tmp_path / "v"), docs.replace("a", "c"))
    rows.write.parquet(str(tmp_path / "w"))  # without a fingerprint, by the number of rows
    assert files.vectors(spark, str(tmp_path / "w"), docs.replace("a", "c")).count() == 2
    with pytest.raises(ValueError):
        files.vectors(spark, str(tmp_path / "w"), docs.limit(1))
