"""Jobs whose results or bounds depended on the size of their tables."""

import numpy as np

from corpusloom.functions import text
from corpusloom.operators import neighbours as N
from corpusloom.operators import shortlist as S
from corpusloom.operators import term_vectors as T
from corpusloom.plans import topics, training


def test_exact_neighbours_of_several_blocks_miss_none(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).round(1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    got = {r["id"]: [(n["id"], n["d"]) for n in r["neighbours"]] for r in N.exact_neighbours(df, 6, block=400).collect()}
    for k in range(len(x)):
        d = N._pair_distances(np.repeat(x[k : k + 1], len(x), 0), x)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != k][:6]
        assert got[k] == [(j, d[j]) for j in order]
    assert N.exact_neighbours(df.limit(1)).count() == 0
    assert sorted(r["id"] for r in N.exact_neighbours(df.limit(2), 6).collect()) == [0, 1]


def test_pairs_counted_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [["w" + str(min(int(x), 40)) for x in rng.zipf(1.3, n)] for n in (1, 2, 3, 700, 40, 0, 5)]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").coalesce(1)
    want = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, min(i + 5, len(t))):
                for pair in ((t[i], t[j]), (t[j], t[i])):
                    want[pair] = want.get(pair, 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for at_once, pairs, terms in ((1 << 21, 1 << 23, 1 << 21), (20, 64, 1 << 21), (20, 64, 3)):
            monkeypatch.setattr(T, "AT_ONCE", at_once)
            monkeypatch.setattr(T, "PART_PAIRS", pairs)
            monkeypatch.setattr(T, "MOST_TERMS", terms)
            for least in (1, 5):
                got = {(r["term"], r["other"]): r["n"] for r in T.near_pairs(df, least=least).collect()}
                assert got == {p: n for p, n in want.items() if n >= least}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_text_vectors_of_slices(spark, monkeypatch):
    rows = [(k, ["a", "b", "a", "c", "x"][: k + 1]) for k in range(5)] + [(9, []), (10, None), (11, ["x"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 1.0])], "term string, vector array<double>")
    found = lambda: {r["doc_id"]: [round(x, 12) for x in r["vector"]] for r in T.text_vectors(df, vectors).collect()}
    whole = found()
    assert sorted(whole) == [0, 1, 2, 3, 4] and whole[0] == [1.0, 0.0]
    monkeypatch.setattr(T, "SLICE_TERMS", 1)
    assert found() == whole


def test_matches_move_few_rows(spark):
    rows = [(k, "en", "p%d" % (k % 2), ["t%d" % j for j in range(k % 5)] * 2, "text") for k in range(40)] + [(99, "en", "ALL", ["t0"], "text"), (98, None, "p0", None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, keyword string, period_label string, tokens array<string>, preview string")
    asked = spark.createDataFrame([("en", "ALL", "t0"), ("en", "p1", "t1"), ("de", "ALL", "t0")], "keyword string, period_label string, term string")
    found = S.matches(docs, asked)
    have = lambda r, t: r[3] and t in r[3] and r[1] == "en"
    want = [(r[0], "ALL", "t0") for r in rows if have(r, "t0") for _ in range(1 + (r[2] == "ALL"))] + [(r[0], "p1", "t1") for r in rows if have(r, "t1") and r[2] == "p1"]
    assert sorted(tuple(r) for r in found.select("doc_id", "_level", "term").collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_window_sums_move_no_windows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "x", "c", None, "a"]), (2, ["a"]), (3, []), (4, None), (5, ["x", "y"])], "doc_id long, tokens array<string>")
    terms = spark.createDataFrame([(0, "a", 0.6), (0, "b", 0.8), (3, "a", 1.0), (-1, "x", 1.0)], "topic_id int, term string, term_weight double")
    weights = {0: {"a": 0.6, "b": 0.8}, 3: {"a": 1.0}}
    want = {}
    for doc, text in ((1, ["a", "b", "a", "x", "c", None, "a"]), (2, ["a"])):
        windows = [list(range(s, min(s + 4, len(text)))) for s in range(max(len(text) - 4, 0) + 1)]
        for topic, w in weights.items():
            near = []
            for places in windows:
                part = [text[p] for p in places]
                size = sum(1 if x is None else part.count(x) for x in part) ** 0.5
                s = sum(w.get(x, 0) for x in part) / size
                near.append(s if s >= 0.1 else 0)
            each = [[n for n, places in zip(near, windows) if p in places] for p in range(len(text))]
            want[doc, topic] = sum(sum(e) / len(e) for e in each)
    found = topics.topic_distributions(docs, terms)
    assert dict(found.dtypes) == {"doc_id": "bigint", "topic_id": "int", "share": "double"}
    got = {(r["doc_id"], r["topic_id"]): r["share"] for r in found.collect()}
    assert sorted(got) == sorted(want)
    for (doc, topic), share in got.items():
        assert abs(share - want[doc, topic] / (want[doc, 0] + want[doc, 3])) < 1e-12
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning") == 1


def test_training_rows_are_kept_in_files():
    network = training.Network(words={f"w{k}": k for k in range(9)})
    texts = ["w1 w1 w2", "", "w8 " * 70_000 + "w3", "w0 none w5"]
    rows = training.Stored()
    for k, t in enumerate(texts):
        rows.add(*network.counted(t), k % 2)
    assert len(rows) == 4 and rows[4:8] == []
    got = [*rows[0:3], *rows[3:9]]
    for k, ((at, x), label) in enumerate(got):
        want = network.sparse(texts[k])
        assert label == k % 2 and at.tolist() == want[0].tolist() and x.tolist() == want[1].tolist()


def test_answers_are_mended_once(spark):
    df = spark.createDataFrame([("```json\n{'tangping_related_label': '相关', 'confidence': 'high', 'reason': 'r',}\n```",), ("{\"a\": ",), (None,)], "raw string")
    out = df.select(text.checked_answer("raw").alias("a")).select("a.*")
    assert [tuple(r) for r in out.collect()] == [(True, "相关", "无", "高", "r", ""), (False, None, "其他", None, "", "not_object"), (False, None, "其他", None, "", "not_object")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json)?") == 1
