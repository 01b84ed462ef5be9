import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import suffix_dedup
from corpusloom.llm.suffix_dedup import bucket_pointers, op1_suffix_array_dedup, remove_repeats, without_repeats


def brute(rows, window=50):
    """(n_bytes, n_removed, n_spans, kept) of each row, in the order of rows."""
    least = {}
    key = lambda d: (d is None, d or 0)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < key(d):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, kept))
    return out


def found(df, **options):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in remove_repeats(df, **options).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_bucket_pointers_sort_suffixes():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 100, 3000), np.tile(rng.integers(97, 100, 70), 20)]).astype(np.uint8)
    text = buf.tobytes()
    for depth in (8, 13, 50):
        p = bucket_pointers(buf, depth)
        keys = [text[i : i + depth].ljust(depth, b"\0") for i in range(len(text))]
        order = {k: n for n, k in enumerate(sorted(set(keys)))}
        assert np.unique(p, return_inverse=True)[1].tolist() == [order[k] for k in keys]


def test_bucket_pointers_with_room():
    """Of texts side by side, only suffixes that lie whole in one are told apart to the depth."""
    rng = np.random.default_rng(2)
    size = rng.integers(50, 90, 200)
    buf = rng.integers(97, 99, size.sum()).astype(np.uint8)
    buf[3000:6000] = buf[:3000]
    room = np.repeat(np.cumsum(size), size) - np.arange(len(buf))
    whole = np.flatnonzero(room >= 50)
    p = bucket_pointers(buf, 50, room)[whole]
    keys = [buf[i : i + 50].tobytes() for i in whole]
    assert len(set(zip(keys, p.tolist(), strict=True))) == len(set(keys)) == len(set(p.tolist())) < len(keys)


def phrases_and_noise():
    rng = random.Random(3)
    words = ["ab", "cde", "fghij", "é", "日本"]
    phrases = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice(phrases)[rng.randrange(40) :][: rng.randrange(20, 120)] if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randrange(80))) for _ in range(5)]
        rows.append((d * 3 % 61, "".join(parts)))
    return [*rows, (200, "a" * 500), (201, "a" * 300), (202, "ab" * 200), (203, "ab" * 100 + "x"), (203, "ab" * 100 + "x"), (204, None), (None, "a" * 60), (None, "ab" * 70), (None, "q" + "ab" * 70)]


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
@pytest.mark.parametrize("hot_runs", [0, 64, 10**9])
def test_matches_brute_force(spark, block_bytes, hot_runs):
    """Whatever the blocks, and whether buckets are refined by runs or by windows."""
    rows = phrases_and_noise()
    same(found(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes, hot_runs=hot_runs), brute(rows))


def in_one_process(rows, blocks, buckets, window=50, hot_runs=64):
    """The stages of the query without Spark; also the windows that pointers decided."""
    number = lambda k: (pa.scalar(k, pa.int32()),)
    tables = [pa.table({"doc_id": pa.array([r[0] for r in rows[k::blocks]], pa.int64()), "text": pa.array([(r[1] or "").encode() for r in rows[k::blocks]], pa.binary())}) for k in range(blocks)]
    by = lambda t, column, k: t.filter(pa.compute.equal(t[column], k))
    said = pa.concat_tables([suffix_dedup._announce(buckets, window, hot_runs)(number(k), t) for k, t in enumerate(tables)])
    said = pa.concat_tables([suffix_dedup._judge(number(k), by(said, "dest", k)) for k in range(buckets)])
    asked = pa.concat_tables([suffix_dedup._request(buckets, window, hot_runs)(number(k), t, by(said, "block", k)) for k, t in enumerate(tables)])
    asked = pa.concat_tables([suffix_dedup._refine(window)(number(k), by(asked, "dest", k)) for k in range(buckets)])
    cut = pa.concat_tables([suffix_dedup._cut(window)(number(k), t, by(asked, "block", k)) for k, t in enumerate(tables)])
    blobs = [suffix_dedup.unpack(x) for x in asked["blob"].to_pylist()]
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in cut.to_pylist()], sum(len(b[1]) for b in blobs if b[0][0] == 2)


@pytest.mark.parametrize("hot_runs", [0, 3, 64])
@pytest.mark.parametrize("values", [1, 3, None])
def test_hashes_decide_nothing(monkeypatch, values, hot_runs):
    """With content hashes that have one or three values the result is the same: bytes are compared, or refined by pointers."""
    if values:
        plain = suffix_dedup._window_hashes
        monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda *a: plain(*a) % np.uint64(values))
        grams = suffix_dedup._gram_hashes
        monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda *a: grams(*a) % np.uint64(40))
    rows = phrases_and_noise()
    for blocks, buckets in ((1, 1), (5, 3), (len(rows), 4)):
        got, refined = in_one_process(rows, blocks, buckets, hot_runs=hot_runs)
        same(got, brute(rows))
        assert refined or blocks == 1


def test_a_line_that_most_documents_hold(spark):
    """Its bucket is hot in every block: other text stands around it in each document."""
    rng = random.Random(5)
    line = "This very line stands in nearly all of the documents of the whole collection."
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(70))
    rows = [(d, noise() + line + noise()) for d in range(400)]
    same(found(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000), brute(rows))


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    same(found(odd_documents), brute(rows))
    assert remove_repeats(no_documents).count() == 0
    out = without_repeats(odd_documents)
    assert out.columns == odd_documents.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert 6 not in kept and 9 not in kept and kept[3]["text"] is None and kept[1]["text"].endswith("first tail") and kept[2]["text"] == "second head "[: len(kept[2]["text"])]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, k, s, hashlib.sha256(t).hexdigest()) for d, n, k, s, t in brute(rows)]
    same([tuple(r) for r in op1_suffix_array_dedup(spark, sf).collect()], want)
