"""Vectors learned from a corpus against numpy on the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import term_vectors as T
from corpusloom.plans import queries_words


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of three subjects with a few words in common."""
    rng = np.random.default_rng(4)
    subjects = [[f"{s}{k}" for k in range(12)] for s in "abc"]
    rows = [(k, [str(rng.choice(subjects[k % 3])) if rng.random() < 0.85 else f"z{rng.integers(0, 5)}" for _ in range(rng.integers(0, 30))]) for k in range(240)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4), rows


def brute_pairs(rows, window):
    out = {}
    for _, t in rows:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + window]:
                out[a, b] = out.get((a, b), 0) + 1
                out[b, a] = out.get((b, a), 0) + 1
    return out


def brute_pmi(pairs, least, smooth=0.75):
    pairs = {p: n for p, n in pairs.items() if n >= least}
    counts = {}
    for (a, _), n in pairs.items():
        counts[a] = counts.get(a, 0) + n
    counts = {a: n**smooth for a, n in counts.items()}
    mass, whole = sum(counts.values()), sum(pairs.values())
    out = {(a, b): math.log(n / whole / (counts[a] / mass * counts[b] / mass)) for (a, b), n in pairs.items()}
    return {p: w for p, w in out.items() if w > 0}


def test_pairs_and_weights(corpus):
    df, rows = corpus
    pairs = T.near_pairs(df, window=3)
    assert {(r["term"], r["other"]): r["n"] for r in pairs.collect()} == brute_pairs(rows, 3)
    got = {(r["term"], r["other"]): r["weight"] for r in T.positive_pmi(pairs, 4).collect()}
    want = brute_pmi(brute_pairs(rows, 3), 4)
    assert got.keys() == want.keys() and all(math.isclose(got[p], w) for p, w in want.items()) and all(got[a, b] == got[b, a] for a, b in got)


def test_leading_vectors_are_those_of_the_matrix(corpus):
    df, rows = corpus
    weights = T.positive_pmi(T.near_pairs(df), 3)
    got = {r["term"]: np.array(r["vector"]) for r in T.leading_vectors(weights, 4, rounds=8).collect()}
    want = brute_pmi(brute_pairs(rows, 4), 3)
    names = sorted({a for a, _ in want})
    m = np.array([[want.get((a, b), 0.0) for b in names] for a in names])
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:4]
    v = np.array([got[n] for n in names])
    assert np.allclose((v**2).sum(0), np.abs(values[order]), rtol=1e-3)
    for k, at in enumerate(order):
        assert abs(abs(v[:, k] @ vectors[:, at]) / np.linalg.norm(v[:, k]) - 1) < 1e-3 and (v[:, k] ** 3).sum() >= 0


def test_neighbours_are_of_one_subject(corpus):
    df, _ = corpus
    got = {r["term"]: np.array(r["vector"]) for r in T.learned_vectors(df, dims=5).collect()}
    names = [n for n in got if n[0] in "abc"]
    cosine = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    assert np.mean([max((b for b in names if b != a), key=lambda b: cosine(a, b))[0] == a[0] for a in names]) > 0.95  # noqa: B023


def test_more_dims_than_terms_and_no_terms(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    rows = T.learned_vectors(df, dims=6, least=1).collect()
    assert {r["term"] for r in rows} <= {"a", "b"} and all(len(r["vector"]) == 6 for r in rows)
    assert T.learned_vectors(df.limit(0), dims=3).collect() == []


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["x"]), (3, []), (4, ["b"])], "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "term string, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in T.text_vectors(df, vectors).collect()}
    rare = {"a": 1e-3 / (1e-3 + 2 / 5), "b": 1e-3 / (1e-3 + 2 / 5)}
    want = [2 * rare["a"] / (2 * rare["a"] + rare["b"]), 2 * rare["b"] / (2 * rare["a"] + rare["b"])]
    assert set(got) == {1, 4} and np.allclose(got[1], want) and got[4] == [0.0, 2.0]
    assert T.text_vectors(df, vectors.limit(0)).collect() == []


def test_an_outside_model(spark):
    df = spark.createDataFrame([(k, "x" * k if k else None) for k in range(150)], "id long, text string")
    got = T.encoded(df, lambda: lambda texts: [[len(t), 1.0] for t in texts], at_once=7).collect()
    assert all(r["vector"] == [float(r["id"]), 1.0] for r in got) and len(got) == 150
    with pytest.raises(Exception, match="vector for each text"):
        T.encoded(df, lambda: lambda texts: []).collect()


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    near = queries_words.learned_neighbours(spark, sf)
    rows = near.collect()
    assert rows and all(-1 <= r["embedding_similarity"] <= 1 for r in rows) and near.groupBy("keyword", "period_label").agg(F.max("neighbor_rank").alias("m")).where("m > 20").count() == 0
    assert queries_words.drift_learned_neighbours(spark, sf).where("overlap_count > 0").count() > 0
    assert queries_words.text_vector_lengths(spark, sf).where("dims <> 16").count() == 0
