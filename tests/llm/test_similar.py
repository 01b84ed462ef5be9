import numpy as np
import pytest

from corpusloom.llm import simhash
from corpusloom.llm.components import local_roots
from corpusloom.llm.simhash import near_duplicates, one_of_each, similar_documents


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, similarity=0.8):
    """component_id of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    roots = local_roots(len(rows), *np.array(near, int).reshape(-1, 2).T)
    label = lambda i: (1 << 63) - 1 if rows[i][0] is None else rows[i][0]
    return [min(label(j) for j in np.flatnonzero(roots == r)) for r in roots]


def cut(words, start, length):
    return " ".join(words[start : start + length])


@pytest.fixture(scope="module")
def corpus():
    """Windows of one text: shifted by s of n shingles, two are (n - s) / (n + s) alike."""
    rng = np.random.default_rng(8)
    rows = []
    for shift, n in [(s, n) for n in (40, 400) for s in (n // 12, n // 10, n // 9, n // 9 + 1, n // 8, n * 3 // 20, n * 3 // 17)] * 4:
        words = [f"w{k}" for k in rng.integers(0, 10**9, n + shift + 4)]
        rows += [cut(words, 0, n + 4), cut(words, shift, n + 4)]
    for n in (8, 10, 12):
        for k in range(12):
            words = [f"s{n}x{k}x{j}" for j in range(n)]
            rows += [" ".join(words), " ".join([*words[:-1], "other"])]
    line = " ".join(f"line{k}" for k in range(16))
    for k in range(6):
        rows.append(" ".join([f"own{k}x{j}" for j in range(404)] + [line] * 30))
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


def found(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_links_only_what_is_alike(spark, corpus):
    """Long texts at 0.7, short ones of which a word differs, and repeated lines are kept apart."""
    want = dict(zip((d for d, _ in corpus), brute_force(corpus), strict=True))
    got = found(spark, corpus)
    assert [d for d in want if want[d] == d and got[d] != d] == []


def test_misses_nothing_that_is_alike(spark, corpus):
    """Pairs at exactly 0.8 and just above are found, whatever else the table has."""
    want = dict(zip((d for d, _ in corpus), brute_force(corpus), strict=True))
    got = found(spark, corpus)
    assert [d for d in want if want[d] != d and got[d] == d] == []
    assert got == want
    pairs = [(d, t) for d, t in corpus if len(shingles(t)) == 400][:40]
    assert found(spark, pairs) == dict(zip((d for d, _ in pairs), brute_force(pairs), strict=True))


def test_null_and_repeated_ids(spark):
    """Texts of null or repeated ids are documents of their own, and don't link what is near to them."""
    text = lambda k: [f"t{k}x{j}" for j in range(300)]
    near = lambda k: " ".join([*text(k)[:-1], "other"])
    rows = [(1, " ".join(text(1))), (None, near(1)), (2, " ".join(text(2))), (None, near(2)), (None, " ".join(text(3))), (None, " ".join(text(4))), (None, " ".join(text(4))), (5, " ".join(text(5))), (5, " ".join(text(6))), (7, near(6)), (8, near(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in one_of_each(docs).collect())
    assert got == sorted((str(d), t) for d, t in [rows[k] for k in (0, 2, 4, 5, 7, 8)])
    same = lambda rows: sorted((str(r["doc_id"]), r["component_id"]) for r in rows.collect())
    last = (1 << 63) - 1
    want = [1, 1, 2, 2, last, last, last, 5, 5, 5, 5]
    assert same(similar_documents(docs)) == sorted((str(d), c) for (d, _), c in zip(rows, want, strict=True))
    assert same(near_duplicates(docs, bits=8)) == sorted((str(d), c) for (d, _), c in zip(rows, want, strict=True))


def test_stage_keeps_one_of_each_group(spark, corpus):
    docs = spark.createDataFrame([*corpus, (None, "a text of no number at all"), (None, "another text without any number")], "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    want = {t for (d, t), c in zip(rows, brute_force(rows), strict=True) if d is None or c == d}
    got = [r["text"] for r in one_of_each(docs).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("salt_rows", [7, 1 << 20])
def test_large_groups_fold_first(spark, salt_rows):
    """A text, copies with some words changed that are far from each other, copies of those, and single texts beside them."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(150)]
    rows = [" ".join(base)]
    for k in range(120):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            words[at] = f"c{k}x{at}"
        rows.append(" ".join(words))
        if k % 10 == 0:
            words[75] = "again"
            rows.append(" ".join(words))
    rows += [" ".join(f"s{k}x{j}" for j in range(100)) for k in range(50)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash._groups(docs, 0.8, "doc_id", "text", 5, 0.999, salt_rows).collect()}
    assert got == dict(zip((d for d, _ in rows), brute_force(rows), strict=True))


def test_sets_of_one_number(spark, corpus):
    """Sets whose first numbers, of four values, are equal are told apart by the second."""

    def few(hashes, check):
        import xxhash

        return xxhash.xxh64_intdigest(hashes.tobytes(), 9) if check else int(hashes[0]) % 4

    some = corpus[:20]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash._groups(docs, 0.8, "doc_id", "text", 5, 0.999, number=few).collect()}
    assert got == dict(zip((d for d, _ in some), brute_force(some), strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_documents(spark, sf):
    """Links of all pairs 0.8 alike or more are found, and no others, on whole tables."""
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect())
    assert found(spark, rows) == dict(zip((d for d, _ in rows), brute_force(rows), strict=True))


def test_texts_of_one_template(spark):
    """Most pairs are some 0.63 alike, some above 0.8, a few of few words; nothing is linked that all pairs don't link, and nothing left out."""
    import random

    r = random.Random(7)
    base, short = [f"w{r.randint(0, 9999)}" for _ in range(120)], [f"s{k}" for k in range(22)]
    texts = []
    for _ in range(150):
        w, at = list(base), r.randint(0, 108)
        w[at : at + 12] = [f"x{r.randint(0, 40)}" for _ in range(12)]
        texts.append(" ".join(w))
    texts += [" ".join(t.split()[:-2]) for t in texts[:5]] + [" ".join([*short[:k], *short[k + 1 :]]) for k in range(0, 22, 3)]
    want = brute_force(list(enumerate(texts)))
    got = similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(want)) and 50 < len(set(want)) < len(texts)
