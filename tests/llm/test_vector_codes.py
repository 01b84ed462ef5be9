"""Product codes against brute force, in every arithmetic, with bounds that save work and never change a result."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from corpusloom.llm import vector_codes as V

SCHEMA = "label int, vec_id long, embedding array<float>, code string, of string, v string"


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, vector): (code, error)} and codebooks, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    q = [[V.whole(x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in q]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((gap(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(p, c[p])[1] for c in cut]
            for k in set(own):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in o), sum(d for d, _ in o)) for r, o in zip(kept, out, strict=True)), key=repr), books


def both(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(0, *r) for r in rows], f"label int, vec_id long, embedding array<{kind}>")
    codes, books = V.product_codes(df, **kw)
    return sorted(((r["vec_id"], r["code"], r["error"]) for r in codes.collect()), key=repr), books


def clustered(n, dim, seed, scale=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim)) / 8
    return [(int(k), [float(np.float32(x)) for x in centres[k % 10] + scale * rng.normal(size=dim)]) for k in rng.permutation(n)]


@pytest.mark.parametrize("dim", [16, 20])
def test_equals_brute_force(spark, dim):
    rows = clustered(300, dim, dim)
    got, want = both(spark, rows), brute(rows)
    assert got == want


def test_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k // 2), [float(x) / 4096 for x in rng.integers(-2, 3, 16)]) for k in range(200)]
    rows += rows[:50] + [(7, rows[0][1])] * 40
    assert both(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e3, 1e7, 1e30, 1e305])
def test_every_size_of_number(spark, scale):
    rows = [(k, [x * scale for x in v]) for k, v in clustered(60, 16, 5)]
    got, want = both(spark, rows, "double"), brute(rows)
    fits = lambda e: e if e < 1 << 63 else None
    assert got == ([(i, c, fits(e)) for i, c, e in want[0]], want[1])


def test_few_rows_and_one_entry(spark):
    rows = clustered(5, 16, 2)
    assert both(spark, rows) == brute(rows)
    assert both(spark, rows, entries=1) == brute(rows, entries=1)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [None, [], [1.0], [None, 1.0], [inf, 1.0], [-inf], [nan], [0.5] * 9, [0.25] * 16]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, [0.5] * 9), (3, [0.1] * 4)]
    assert both(spark, rows) == brute(rows)
    df = spark.createDataFrame([(None if k % 2 else 1, i, v, "x", "y", "z") for k, (i, v) in enumerate(rows)], SCHEMA)
    codes, _ = V.product_codes(df)
    assert codes.columns == ["vec_id", "label", "code", "error"] and codes.count() == len(brute(rows)[0])


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [None])]):
        codes, books = both(spark, rows)
        assert codes == [] and books == []


def test_only_empty_vectors(spark):
    assert both(spark, [(1, []), (2, [])]) == brute([(1, []), (2, [])])


def test_blocks_change_nothing(spark, monkeypatch):
    rows = clustered(200, 16, 9)
    monkeypatch.setattr(V, "MOST_ROWS", 7)
    assert both(spark, rows) == brute(rows)


def test_bounds_save_distances():
    numbers = V.Numbers(1.0, 8, 2)
    rows = clustered(4000, 16, 3)
    q = numbers.quantised(np.array([v for _, v in rows])).reshape(-1, 8, 2)[:, 0]
    coder = V.Coder(numbers, [q[:16].tolist()] * 8)
    own, upper, lower = np.zeros(len(q), np.int64), np.full(len(q), np.inf, np.float32), np.zeros((len(q), coder.most_groups), np.float32)
    full, computed = len(q) * 16, []
    for _ in range(6):
        computed.append(coder.reassign(0, q, own, upper, lower))
        want = ((q[:, None] - np.array(coder.codebooks[0])[None]) ** 2).sum(2)
        assert np.array_equal(own, want.argmin(1))
        assert (upper.astype(float) ** 2 >= want.min(1)).all()
        sums = np.zeros((8, 16, 3), object)
        sums[0] = V._sums(q[:, None], own[:, None].astype(np.uint8), 16)[0]
        coder = coder.moved(sums)
    assert computed[0] >= full and max(computed[2:]) < full / 2


def test_query_has_sums_of_labels_and_the_digest(spark, sf):
    rows = V.op11_vector_codes(spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert sorted(map(tuple, rows)) == sorted(con.execute(V.ORACLE).fetchall())
    vectors = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    codes, books = brute(vectors)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in rows) == sorted(codes)
    assert {r["codebooks_sha256"] for r in rows} == {hashlib.sha256(",".join(str(v) for c in books for e in c for v in e).encode()).hexdigest()}


def test_hot_and_null_labels(spark, tmp_path):
    rows = [(None if k % 3 == 0 else 1 if k % 3 == 1 else k, i, v) for k, (i, v) in enumerate(clustered(90, 16, 4))]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in V.op11_vector_codes(spark, str(tmp_path)).collect()}
    label = {r[1]: r[0] for r in rows}
    assert len(got) == 90
    for k, r in got.items():
        assert r["label_error"] == sum(x["error"] for i, x in got.items() if label[i] == label[k])
