"""Density clusters against a tree built from the top, the neighbour graph and layout against all pairs."""

import math

import numpy as np
import pytest

from corpusloom.operators import density, graph, neighbours


def blobs(seed=0, each=40):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (each, 3)) for c, s in ((0, 0.3), (4, 0.3), (5.5, 0.25), (-6, 1.0))] + [rng.uniform(-12, 12, (25, 3))])
    return np.concatenate([x, np.repeat(x[:2], [14, 3], axis=0)])


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def brute_edges(x, copies, neighbours_of, samples):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = []
    for k in range(n):
        held, at = copies[k] - 1, 0.0
        for j in sorted((j for j in range(n) if j != k), key=lambda j: (d[k, j], j))[:neighbours_of]:
            if held >= samples:
                break
            at, held = d[k, j], held + copies[j]
        core.append(at)
    near = lambda k: sorted((j for j in range(n) if j != k), key=lambda j: (d[k, j], j))[:neighbours_of]
    return {(min(k, j), max(k, j)): max(d[k, j], core[k], core[j]) for k in range(n) for j in near(k)}


def brute_forest(n, edges):
    sets, out = list(range(n)), []
    def find(a):
        while sets[a] != a:
            a = sets[a]
        return a
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        ra, rb = find(a), find(b)
        if ra != rb:
            sets[ra] = rb
            out.append((a, b, w))
    return out


def brute_clusters(n, copies, forest, m):
    """Labels and probabilities, from the whole downwards: the heaviest edge is cut first."""
    size = lambda c: sum(copies[k] for k in c)
    dense = lambda w: 1 / max(w, density.LEAST)

    def parts(points, edges):
        left, out = set(points), []
        links = {}
        for a, b, _ in edges:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        while left:
            stack, seen = [min(left)], set()
            while stack:
                if (k := stack.pop()) not in seen:
                    seen.add(k)
                    stack += links.get(k, [])
            left -= seen
            out.append((seen, [e for e in edges if e[0] in seen]))
        return out

    def node(points, edges, birth):
        """(points that leave it with density, children, birth)"""
        falls, children = {}, []
        while True:
            if not edges:
                falls |= {k: dense(0.0) for k in points}
                break
            last = max(edges, key=lambda e: (e[2], e[0], e[1]))
            at = dense(last[2])
            both = parts(points, [e for e in edges if e != last])
            large = [p for p in both if size(p[0]) >= m]
            if len(large) == 2:
                children = [node(*p, at) for p in large]
                break
            for p in both:
                if p not in large or not large:
                    falls |= {k: at for k in p[0]}
            if not large:
                break
            points, edges = large[0]
        return {"falls": falls, "children": children, "birth": birth, "points": set(falls).union(*(c["points"] for c in children))}

    tops = [node(*p, 0.0) for p in parts(range(n), forest) if size(p[0]) >= m]
    chosen = []

    def best(t, top):
        own = sum((at - t["birth"]) * copies[k] for k, at in t["falls"].items()) + sum((c["birth"] - t["birth"]) * size(c["points"]) for c in t["children"])
        below, those = 0.0, []
        for c in t["children"]:
            v, some = best(c, False)
            below, those = below + v, those + some
        if t["children"] and below > own or top and len(tops) == 1:
            return below, those
        return own, [t]

    for t in tops:
        chosen += best(t, True)[1]
    chosen.sort(key=lambda t: (-size(t["points"]), min(t["points"])))
    labels, chance = {k: -1 for k in range(n)}, {}
    for number, t in enumerate(chosen):
        last = max([*t["falls"].values(), *(c["birth"] for c in t["children"])])

        def walk(c, number=number, last=last):
            for k, at in c["falls"].items():
                labels[k], chance[k] = number, min(1.0, at / last)
            for x in c["children"]:
                walk(x)

        walk(t)
    return labels, chance


@pytest.mark.parametrize("near", [1000, 12])
@pytest.mark.parametrize("tail", [graph.TAIL, 40])
def test_clusters_are_those_of_the_whole_tree(spark, near, tail):
    """On all pairs and on a graph of 12 neighbours, in one task and in rounds."""
    x = blobs()
    points, keys = neighbours.distinct_points(frame(spark, x))
    assert points.count() == len(x) - 17 and keys.count() == len(x)
    g = neighbours.neighbour_graph(points, near)
    of = {r["id"]: r["copies"] for r in points.collect()}
    y, copies = x[sorted(of)], [of[k] for k in sorted(of)]
    forest = brute_forest(len(y), brute_edges(y, copies, near, 5))
    got = sorted(map(tuple, graph.spanning_forest(density.mutual_reachability(g, points, 5), tail).collect()))
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in forest) and np.allclose([w for *_, w in got], [w for *_, w in sorted(forest)])
    labels, chance = brute_clusters(len(y), copies, forest, 10)
    found = {r["id"]: r for r in density.density_clusters(g, points, 10, 5, tail).collect()}
    assert {k: r["cluster"] for k, r in found.items()} == labels and len(set(labels.values())) >= 4 and -1 in labels.values()
    for k, r in found.items():
        assert (r["probability"] is None) if labels[k] == -1 else math.isclose(r["probability"], chance[k], rel_tol=1e-9)


def test_few_points(spark):
    for x in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 30, [[1.0, 2.0], [2.0, 1.0]]):
        points, _ = neighbours.distinct_points(frame(spark, x))
        found = density.density_clusters(neighbours.neighbour_graph(points), points, 10).collect()
        assert [r["cluster"] for r in found] == [-1] * points.count()
    odd = spark.createDataFrame([(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [3.0, 4.0])], "vec_id long, embedding array<double>")
    points, keys = neighbours.distinct_points(odd, cosine=True)
    assert sorted((r["id"], r["vector"]) for r in points.collect()) == [(4, [0.0, 0.0]), (5, [0.6, 0.8])] and keys.count() == 2


def test_components_in_rounds(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)]
    df = spark.createDataFrame(links, "u long, v long")
    whole = sorted(map(tuple, graph.components(df).collect()))
    assert sorted(map(tuple, graph.components(df, tail=0).collect())) == whole
    sets = graph.Sets()
    for a, b in links:
        if (x := sets.find(a)) != (y := sets.find(b)):
            sets.join(x, y)
    assert whole == sorted((k, sets.find(k)) for k in {k for link in links for k in link})


def true_neighbours(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [set(np.argsort(row, kind="stable")[:k].tolist()) for row in d]


def recall(rows, want):
    return np.mean([len({n["id"] for n in r["neighbours"]} & want[r["id"]]) / len(want[r["id"]]) for r in rows])


def test_neighbours_of_small_blocks(spark):
    """Blocks alone miss many; those who are introduced to each other find nine in ten."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (60, 8)) for c in rng.normal(0, 3, (10, 8))])
    points = frame(spark, x).selectExpr("vec_id as id", "embedding as vector")
    want = true_neighbours(x, 10)
    alone = recall(neighbours.neighbour_graph(points, 10, orders=3, block=64, rounds=0).collect(), want)
    rows = neighbours.neighbour_graph(points, 10, orders=3, block=64, rounds=2).collect()
    assert alone < 0.85 and recall(rows, want) >= 0.9 and len(rows) == len(x)
    d = lambda a, b: math.sqrt(((x[a] - x[b]) ** 2).sum())
    assert all(math.isclose(n["d"], d(r["id"], n["id"]), rel_tol=1e-9) and n["id"] != r["id"] for r in rows for n in r["neighbours"])
    assert all([(n["d"], n["id"]) for n in r["neighbours"]] == sorted((n["d"], n["id"]) for n in r["neighbours"]) for r in rows)


def test_recall_on_the_embeddings(spark):
    """Of 15 neighbours of 2000 vectors without clusters in 64 dimensions, with blocks of half of them."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    points, _ = neighbours.distinct_points(e)
    rows = {r["id"]: r["vector"] for r in points.collect()}
    ids = sorted(rows)
    want = [{ids[j] for j in near} for near in true_neighbours(np.array([rows[k] for k in ids]), 15)]
    found = neighbours.neighbour_graph(points, 15).collect()
    assert recall(found, dict(zip(ids, want, strict=True))) >= 0.9


def test_layout_keeps_more_neighbours_than_principal_components(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    points, _ = neighbours.distinct_points(e, cosine=True)
    g = neighbours.neighbour_graph(points, 15)
    rows = {r["id"]: np.array(r["vector"]) for r in points.collect()}
    ids = sorted(rows)
    x = np.array([rows[k] for k in ids])
    want = true_neighbours(x, 15)
    kept = lambda y: np.mean([len(a & b) / 15 for a, b in zip(true_neighbours(y, 15), want, strict=True)])
    place = {r["id"]: r["place"] for r in neighbours.layout(points, g).collect()}
    flat = x - x.mean(0)
    pca = flat @ np.linalg.svd(flat, full_matrices=False)[2][:5].T
    assert kept(np.array([place[k] for k in ids])) > 1.4 * kept(pca)
    split = {r["id"]: r["place"] for r in neighbours.layout(points, g, rounds=3, block=100).collect()}
    assert set(split) == set(ids) and kept(np.array([split[k] for k in ids])) > kept(pca)


def test_fuzzy_weights(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    g = neighbours.neighbour_graph(frame(spark, x).selectExpr("vec_id as id", "embedding as vector"), 8)
    near = {r["id"]: [(n["id"], n["d"]) for n in r["neighbours"]] for r in g.collect()}
    got = {(r["u"], r["v"]): r["weight"] for r in neighbours.fuzzy_weights(g).collect()}
    one = {}
    for k, some in near.items():
        rho, low, high = some[0][1], 1e-9, 1e9
        for _ in range(200):
            mid = math.sqrt(low * high)
            low, high = (low, mid) if sum(math.exp(-max(0, d - rho) / mid) for _, d in some) > math.log2(8) else (mid, high)
        one |= {(k, o): math.exp(-max(0, d - rho) / low) for o, d in some}
    want = {}
    for a, b in one:
        p, q = one[a, b], one.get((b, a), 0.0)
        want[min(a, b), max(a, b)] = p + q - p * q
    assert got.keys() == want.keys() and all(math.isclose(got[e], want[e], rel_tol=1e-6, abs_tol=1e-9) for e in want)


def test_vectors_are_cut_to_length_once(spark, monkeypatch):
    """No table that is written from others computes lengths again: once within a vector they cost the square of its components."""
    plans = []
    written = neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    points, keys = neighbours.distinct_points(frame(spark, np.array([[3.0, 4.0], [6.0, 8.0], [0.0, 0.0], [-1.0, 0.0]])), cosine=True)
    assert sum(p.count("aggregate(") for p in plans) == 1
    assert sorted((r["id"], r["copies"], r["vector"]) for r in points.collect()) == [(0, 2, [0.6, 0.8]), (2, 1, [0.0, 0.0]), (3, 1, [-1.0, 0.0])]
    assert sorted(map(tuple, keys.collect())) == [(0, 0), (1, 0), (2, 2), (3, 3)]


@pytest.mark.parametrize("scale", [1.0, 2.0**-10, 2.0**66, 2.0**664])
def test_ties_go_to_smaller_ids(scale):
    """A grid, where many are equally far, and near copies that single precision can't tell apart."""
    x = np.array([[a, b] for a in range(12) for b in range(12)], float)
    x = np.concatenate([x, 40 + np.arange(60)[:, None] * [1e-6, 0]])
    ids = np.random.default_rng(4).permutation(len(x))
    where, d = neighbours.nearest(x * scale, ids, 9)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in range(len(x)):
        want = sorted((j for j in range(len(x)) if j != k), key=lambda j: (far[k, j], ids[j]))[:9]
        assert np.allclose(d[k], far[k, want] * scale, rtol=1e-6) and (k >= 144 or where[k].tolist() == want)


def test_introduced_pairs_are_those_nearer_than_the_worst():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(40), rng.integers(1, 12, 40))
    x = rng.normal(size=(len(owner), 6))
    x[5:30] = x[5] + rng.normal(size=(25, 6)) * 1e-7
    worst = rng.uniform(0.5, 3, len(owner))
    i, j = neighbours._nearer_pairs(x, owner, worst)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    some = d[i, j] < worst[i]
    want = {(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and owner[a] == owner[b] and d[a, b] < worst[a]}
    assert set(zip(i[some].tolist(), j[some].tolist(), strict=True)) == want and len(i) == len(set(zip(i, j, strict=True)))


def test_blocks_of_a_layout_are_bounded(spark, monkeypatch):
    """Forty blocks of points most of which are in one place: none has many more than its share."""
    import pyarrow as pa

    def counted(*_):
        def sizes(places, edges):
            flat = pa.array(np.full(2 * len(places), float(len(places))))
            return pa.table([places.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * 2, pa.int32()), flat)], ["id", "place"])

        return sizes

    x = np.random.default_rng(9).standard_cauchy((2000, 2))
    points = frame(spark, x).selectExpr("vec_id as id", "embedding as vector")
    g = neighbours.neighbour_graph(points, 5)
    monkeypatch.setattr(neighbours, "_mover", counted)
    sizes = [r["place"][0] for r in neighbours.layout(points, g, 2, rounds=1, block=50).collect()]
    assert len(sizes) == 2000 and max(sizes) <= 75
