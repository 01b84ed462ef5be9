"""Merging of topics, memberships and the ways to give outliers a topic, against plain Python."""

import itertools
import math

import numpy as np
import pytest

from corpusloom.plans import queries_topics, topics


def brute_merges(x, steps):
    """Sets of topics after so many merges of the nearest pair, by the mean over all pairs of members."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    sets, heights = [[k] for k in range(len(x))], []
    mean = lambda a, b: np.mean([d[i, j] for i in a for j in b])
    while steps is None and len(sets) > 1 or steps:
        sets.sort(key=min)
        h, a, b = min((round(mean(a, b), 12), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2))
        heights.append(h)
        sets[a] = sets[a] + sets.pop(b)
        steps = None if steps is None else steps - 1
    return sets, heights


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(8)
    centres = np.concatenate([rng.normal(c, 0.15, (3, 6)) for c in rng.normal(0, 2, (4, 6))])
    rows = [(k, [float(v) for v in centres[t] + rng.normal(0, 0.01, 6)] , t) for k, t in enumerate(rng.integers(-1, 12, 300).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, topic_id int"), rows


@pytest.mark.parametrize("count", [1, 2, 5, 12, 50, "auto"])
def test_topics_merge_as_a_dendrogram(grouped, count):
    df, rows = grouped
    means = np.array([np.mean([v for _, v, t in rows if t == k], axis=0) for k in range(12)])
    if count == "auto":
        _, heights = brute_merges(means, None)
        gaps = np.diff(heights)
        steps = int(gaps.argmax()) + 1
        assert 2 <= 12 - steps <= 4
    else:
        steps = max(0, 12 - count)
    sets, _ = brute_merges(means, steps)
    got = {r["vec_id"]: r["topic_id"] for r in topics.merge_topics(df.select("vec_id", "topic_id"), df, count).collect()}
    members = [sorted(k for k, _, t in rows if t in s) for s in sets]
    members.sort(key=lambda m: (-len(m), m[0]))
    assert got == {k: -1 for k, _, t in rows if t < 0} | {k: n for n, m in enumerate(members) for k in m}


def test_merging_needs_topics(grouped, spark):
    df, _ = grouped
    with pytest.raises(ValueError):
        topics.merge_topics(df.select("vec_id", "topic_id"), df, 0)
    none = df.where("topic_id < 0").select("vec_id", "topic_id")
    assert {r["topic_id"] for r in topics.merge_topics(none, df, "auto").collect()} == {-1}


def test_density_topics_of_blobs(spark):
    """Three blobs on a sphere and strangers; copies share a topic; merged to two on demand."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.04, (n, 12)) + c for n, c in zip((90, 60, 40), np.eye(12)[:3], strict=True)] + [rng.normal(0, 1, (12, 12))])
    x = np.concatenate([x, x[:5], x[:5]])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 12)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in topics.density_topics(df, 12, dims=None).collect()}
    of = lambda a, b: [got[k]["topic_id"] for k in range(a, b)]
    assert len(got) == len(x) and (of(0, 90).count(0), of(90, 150).count(1), of(150, 190).count(2)) >= (85, 55, 36)
    assert all(got[k]["topic_id"] < 0 or got[k]["topic_probability"] < 0.4 for k in range(190, 202)) and -1 in of(190, 202)
    assert of(202, 207) == of(207, 212) == of(0, 5) and all((r["topic_probability"] is None) == (r["topic_id"] < 0) for r in got.values())
    laid = {r["vec_id"]: r["topic_id"] for r in topics.density_topics(df, 12).collect()}
    major = [max(set(m), key=m.count) for m in ([laid[k] for k in range(a, b)] for a, b in ((0, 90), (90, 150), (150, 190)))]
    assert len(set(major)) == 3 and min(major) >= 0
    two = [r["topic_id"] for r in topics.density_topics(df, 12, dims=None, topics=2).collect()]
    assert set(two) == {-1, 0, 1} and two.count(0) > two.count(1)


def test_memberships(spark):
    near = {1: [(0.5, 2), (1.0, 3)], 2: [(0.5, 1), (0.7, 3)], 3: [(0.7, 2), (1.0, 1)], 4: [(2.0, 1), (2.0, 2)]}
    g = spark.createDataFrame([(k, [{"d": d, "id": i} for d, i in n]) for k, n in near.items()], "id long, neighbours array<struct<d: double, id: long>>")
    assigned = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, -1)], "id long, topic_id int")
    got = topics.memberships(g, assigned).collect()
    sums = {}
    for r in got:
        sums[r["id"]] = sums.get(r["id"], 0) + r["membership"]
    assert all(0 < s <= 1 + 1e-9 for s in sums.values()) and {(r["id"], r["topic_id"]) for r in got} == {(1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1)}
    assert math.isclose(sums[4], 1.0) and math.isclose(sums[3], 1.0) and sums[1] < 1
    given = {r["id"]: r["topic_id"] for r in topics.adopt_by_membership(assigned, topics.memberships(g, assigned)).collect()}
    assert given[1] == 0 and given[2] == 1 and given[3] in (0, 1) and given[4] == 0  # equal shares: the smaller id
    assert {r["topic_id"] for r in topics.adopt_by_membership(assigned, topics.memberships(g, assigned), 0.9).where("id = 4").collect()} == {-1}


def brute_shares(tokens, weights, window=4, least=0.1):
    starts = range(max(1, len(tokens) - window + 1))
    sims = []
    for s in starts:
        some = tokens[s : s + window]
        size = math.sqrt(sum(some.count(t) ** 2 for t in set(some)))
        dots = {k: sum(some.count(t) * w.get(t, 0) for t in set(some)) / math.sqrt(sum(v * v for v in w.values())) / size for k, w in weights.items()}
        sims.append({k: v if v >= least else 0 for k, v in dots.items()})
    total = dict.fromkeys(weights, 0.0)
    for p in range(len(tokens)):
        mine = [s for s in starts if s <= p < s + window]
        for k in weights:
            total[k] += sum(sims[s][k] for s in mine) / len(mine)
    whole = sum(total.values())
    return {k: v / whole for k, v in total.items() if v}


def test_distributions_of_windows(spark):
    rng = np.random.default_rng(3)
    weights = {0: {"a": 3.0, "b": 1.0}, 1: {"b": 2.0, "c": 0.5, "d": 1.0}, 2: {"e": 1.0}}
    docs = [(k, -1, rng.choice(list("abcdexyz"), n).tolist()) for k, n in enumerate([0, 1, 2, 4, 5, 9, 40])]
    df = spark.createDataFrame(docs, "doc_id long, topic_id int, tokens array<string>")
    terms = spark.createDataFrame([(k, t, w) for k, ws in weights.items() for t, w in ws.items()] + [(-1, "x", 9.0)], "topic_id int, term string, term_weight double")
    got = {}
    for r in topics.topic_distributions(df, terms).collect():
        got.setdefault(r["doc_id"], {})[r["topic_id"]] = r["share"]
    for k, _, tokens in docs:
        want = brute_shares(tokens, weights) if tokens else {}
        assert got.get(k, {}).keys() == want.keys() and all(math.isclose(got[k][t], want[t]) for t in want)
    given = {r["doc_id"]: r["topic_id"] for r in topics.reduce_outliers(df, "distributions", terms, least=0.2).collect()}
    for k, _, tokens in docs:
        want = brute_shares(tokens, weights) if tokens else {}
        best = min(want, key=lambda t: (-want[t], t)) if want else -1  # noqa: B023
        assert given[k] == (best if want and want[best] >= 0.2 else -1)


def test_strategies(spark):
    docs = spark.createDataFrame([(1, 0, ["a"]), (2, -1, ["a", "b"]), (3, -1, ["z"]), (4, 1, ["c"])], "doc_id long, topic_id int, tokens array<string>")
    terms = spark.createDataFrame([(0, "a", 1.0), (1, "c", 1.0)], "topic_id int, term string, term_weight double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 1.0])], "doc_id long, embedding array<double>")
    members = spark.createDataFrame([(2, 1, 0.4), (3, 0, 0.2)], "doc_id long, topic_id int, membership double")
    run = lambda s, **kw: {r["doc_id"]: r["topic_id"] for r in topics.reduce_outliers(docs, s, terms, vectors, members, **kw).collect()}
    same = {1: 0, 4: 1}
    assert run("none") == same | {2: -1, 3: -1} and run("c-tf-idf") == run("distributions") == run("c-tf-idf+distributions") == same | {2: 0, 3: -1}
    assert run("embeddings") == same | {2: 1, 3: 0} and run("probabilities", least=0.3) == same | {2: 1, 3: -1}
    for bad in ("other", "distributions"):
        with pytest.raises(ValueError):
            topics.reduce_outliers(docs, bad)


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    found = {name: f(spark, sf).collect() for name, f in queries_topics.QUERIES.items() if name not in queries_topics.SQL}
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(found["density_topics"]) == len(found["merged_topics"]) == n and {r["topic_id"] for r in found["merged_topics"]} == {0, 1, 2, 3}
    assert n - 5 <= len(found["reachability_forest"]) < n and len(found["topic_memberships"]) > n
