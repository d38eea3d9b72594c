"""Searches of hashes and vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import cells, hashes, neighbors


def _signed(x):
    return x if x < 1 << 63 else x - (1 << 64)


def _bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def _hash_rows(g, n):
    """Random hashes, copies, and balls of hashes a few bits from each other."""
    base = [int(x) for x in g.integers(0, 2**63, 12)]
    out = []
    for i in range(n):
        h = base[i % 12] if i % 3 else int(g.integers(0, 2**63)) | 1 << 63
        for b in g.integers(0, 64, int(g.integers(0, 6))):
            h ^= 1 << int(b)
        out.append((i, _signed(h)))
    return out + [(n + i, out[0][1]) for i in range(8)] + [(n + 20, None)]


def test_more_rows_make_for_wider_bands():
    assert hashes.best_bands(8, 64, 100) == 9 and hashes.best_bands(8, 64, 10**7) < hashes.best_bands(8, 64, 10**4) < 9
    assert len(hashes.flips(10, 2)) == 1 + 10 + 45


@pytest.mark.parametrize("bands", [None, 2, 5])
def test_pairs_of_hashes_come_once(spark, bands):
    rows = _hash_rows(np.random.default_rng(1), 150)
    df = spark.createDataFrame(rows, "key long, hash long")
    distinct = {h for _, h in rows if h is not None}
    r = 8 if bands != 2 else 3
    got = [(x.hash_a, x.hash_b, x.distance) for x in hashes.hash_pairs(hashes.distinct_hashes(df), hashes.distinct_hashes(df), r, bands=bands).collect()]
    assert sorted(got) == sorted((a, b, _bits(a, b)) for a in distinct for b in distinct if _bits(a, b) <= r)


@pytest.mark.parametrize("block,probes", [(1 << 20, 2000), (16, 0), (64, 100)])
def test_nearest_hash(spark, monkeypatch, block, probes):
    monkeypatch.setattr(hashes, "REFERENCE_BLOCK", block)
    monkeypatch.setattr(hashes, "QUERY_BLOCK", block)
    monkeypatch.setattr(hashes, "MAX_PROBES", probes)
    g = np.random.default_rng(2)
    refs = _hash_rows(g, 90)
    queries = [(1000 + k, h) for k, h in _hash_rows(g, 40)] + [(5, refs[3][1]), (5, refs[3][1]), (6, refs[3][1] ^ 3)]
    q, r = (spark.createDataFrame(x, "key long, hash long") for x in (queries, refs))
    got = sorted(map(tuple, hashes.hamming_nearest(q, r).collect()), key=str)
    want = []
    for k, h in queries:
        d = [] if h is None else [(_bits(h, x), key) for key, x in refs if x is not None]
        want.append((k, min(d)[1], min(d)[0]) if d else (k, 0, None))
    assert got == sorted(want, key=str)
    assert hashes.hamming_nearest(q, r.where("false")).collect() == []
    assert {x.distance for x in hashes.hamming_nearest(q, r.where("hash is null")).collect()} == {None}


def _dbscan(rows, eps, least):
    near = {i: [j for j, (_, y) in enumerate(rows) if x is not None and y is not None and _bits(x, y) <= eps] for i, (_, x) in enumerate(rows)}
    core = {i for i in near if len(near[i]) >= least}
    label, out = {}, {}
    for i in sorted(core, key=lambda i: rows[i][0]):
        if i in label:
            continue
        todo, label[i] = [i], rows[i][0]
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in label:
                    label[j] = rows[i][0]
                    todo.append(j)
    for i, (key, _) in enumerate(rows):
        out[key] = label.get(i, min((label[j] for j in near[i] if j in core), default=-1))
    return out


@pytest.mark.parametrize("eps,least", [(8, 5), (3, 2), (0, 3), (8, 40)])
def test_density_clusters(spark, eps, least):
    rows = _hash_rows(np.random.default_rng(3), 200)
    # A run of neighbouring hashes, whose members agree outside a few bits.
    rows += [(500 + i, _signed(0xABC << 40 | i)) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, hash long")
    assert {x.key: x.cluster for x in hashes.dbscan_hamming(df, eps, least).collect()} == _dbscan(rows, eps, least)


def test_density_clusters_of_many_copies(spark):
    """A hundred thousand copies of one hash are one point; nothing is paired with them."""
    copies = spark.range(100_000).select(F.col("id").alias("key"), F.lit(77).cast("long").alias("hash"))
    others = spark.createDataFrame([(200_000, 78), (200_001, ~77), (200_002, None)], "key long, hash long")
    got = hashes.dbscan_hamming(copies.unionByName(others))
    assert {(x.cluster, x["count"]) for x in got.groupBy("cluster").count().collect()} == {(0, 100_001), (-1, 2)}
    assert hashes.hash_pairs(hashes.distinct_hashes(copies), hashes.distinct_hashes(copies), 8).count() == 1
    near = hashes.hamming_nearest(copies, others)
    assert {(x.ref, x.distance) for x in near.distinct().drop("key").collect()} == {(200_000, 2)}


def _groups(g, n, dims, groups, spread):
    """Unit vectors around a few directions, with copies."""
    c = g.normal(size=(groups, dims))
    v = c[g.integers(0, groups, n)] + spread * g.normal(size=(n, dims))
    v[n // 2 : n // 2 + 10] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("size", [7, 4096])
def test_euclidean_radius_join_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "BLOCK", size)
    g = np.random.default_rng(4)
    v = _groups(g, 150, 6, 5, 0.2)
    v = np.concatenate((v, v[:30] * 5, v[:10], np.zeros((3, 6)), v[:3] + 7e4, v[:3] + 7e4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None), (None, [0.0] * 6), (998, [float("nan")] * 6)], "key long, v array<double>")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    for r in (0.7, 0.0):
        got = [(x.a, x.b, x.distance) for x in neighbors.radius_join_euclid(df, df, r, 9).collect()]
        want = [(a, b) for a in range(len(v)) for b in range(len(v)) if d[a, b] <= r]
        assert sorted(x[:2] for x in got) == want
        assert all(x == pytest.approx(d[a, b], abs=1e-9) for a, b, x in got)
    assert neighbors.radius_join_euclid(df, df.where("false"), 1.0).collect() == []


def test_euclidean_radius_join_compares_few_pairs(spark):
    v = _groups(np.random.default_rng(5), 3000, 32, 40, 0.1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>")
    left, right = cells.ringed(df, df, 0.3, 100)
    n = [x.groupBy("cell", "ring").agg(F.count("*").alias(c)) for x, c in ((left, "l"), (right, "r"))]
    compared = n[0].join(n[1], ["cell", "ring"]).agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    assert compared < 0.2 * 3000**2


@pytest.mark.parametrize("copies,size", [(0, 7), (0, 4096), (float("inf"), 7)])
def test_euclidean_radius_join_in_blocks_and_cells(spark, monkeypatch, copies, size):
    """The same pairs either way: of two sides, and of one side with itself; norms differ, and keys repeat."""
    monkeypatch.setattr(cells, "BLOCK", size)
    monkeypatch.setattr(cells, "COPIES", copies)
    g = np.random.default_rng(8)
    v = np.concatenate((_groups(g, 90, 6, 5, 0.3) * g.integers(1, 4, (90, 1)), np.zeros((2, 6)), np.full((2, 6), 5e3)))
    rows = [(i % 92, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [(999, None), (None, [0.0] * 6), (998, [float("nan")] * 6)], "key long, v array<double>")
    left = df.where("key % 3 = 0")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    for r in (0.8, 0.0):
        near = [(rows[i][0], rows[j][0], d[i, j]) for i in range(len(v)) for j in range(len(v)) if d[i, j] <= r]
        pairs = sorted(tuple(x) for x in neighbors.radius_pairs_euclid(df, r, 9).collect())
        both = sorted(tuple(x) for x in neighbors.radius_join_euclid(left, df, r, 9).collect())
        for got, want in ((pairs, [x for x in near if x[0] < x[1]]), (both, [x for x in near if x[0] % 3 == 0])):
            assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
            assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=1e-9)
    assert neighbors.radius_join_euclid(left.where("false"), df, 0.8).collect() == neighbors.radius_pairs_euclid(df.where("false"), 0.8).collect() == []


def test_euclidean_radius_join_of_numbers_whose_squares_overflow(spark):
    rows = [(i, [1e200 * (1 + i % 3), 0.0]) for i in range(6)]
    for more in ([], [(10, [0.5, 0.5]), (11, [0.5, 0.5])]):
        df = spark.createDataFrame(rows + more, "key long, v array<double>")
        got = {tuple(x) for x in neighbors.radius_join_euclid(df, df, 1.0).where("a < b").collect()}
        assert got == {(0, 3, 0.0), (1, 4, 0.0), (2, 5, 0.0)} | ({(10, 11, 0.0)} if more else set())


def test_euclidean_radius_join_moves_vectors_without_groups_a_few_times(spark):
    """MB shuffled grow as the rows, not as rows times cells."""
    sc = spark.sparkContext
    moved = []
    for n in (2000, 8000):
        v = np.random.default_rng(9).normal(size=(n, 16))
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>")
        sc.setJobGroup(group := f"moved {n}", "")
        neighbors.radius_join_euclid(df, df, 1.2).count()
        sc.setLocalProperty("spark.jobGroup.id", None)
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        store = sc._jsc.sc().statusStore()
        moved.append(sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages))
    assert moved[1] < 2.5 * 8000 * 16 * 8 and moved[1] < 5.5 * moved[0]


@pytest.mark.parametrize("number,size", [(None, 4096), (12, 16)])
def test_largest_inner_products(spark, monkeypatch, number, size):
    monkeypatch.setattr(cells, "BLOCK", size)
    g = np.random.default_rng(6)
    v, q = _groups(g, 300, 8, 6, 0.3) * g.uniform(0.2, 3, (300, 1)), g.normal(size=(40, 8))
    q[0], v[7] = 0, 0
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (None, [9.0] * 8), (901, [float("inf")] * 8)], "key long, v array<double>")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "key long, v array<double>")
    for k in (1, 5, 400):
        got = {(x.key, x["rank"]): (x.ref, x.score) for x in cells.knn_topk(df, refs, k, number).collect()}
        assert len(got) == 40 * min(k, 300)
        for i in range(40):
            s = np.array([(q[i] * x).sum() for x in v])
            for rank, j in enumerate(np.lexsort((np.arange(300), -np.round(s, 9)))[:k], 1):
                assert got[i, rank] == (j, pytest.approx(s[j]))
    assert cells.knn_topk(df, refs.where("false"), 3).collect() == []


@pytest.mark.parametrize("size", [7, 4096])
def test_largest_inner_products_in_blocks(spark, monkeypatch, size):
    """Blocks that lie side by side find what cells find: ties, copies, zero vectors, many and few references."""
    g = np.random.default_rng(10)
    v, q = g.normal(size=(200, 8)) * g.uniform(0.2, 3, (200, 1)), g.normal(size=(40, 8))
    q[0], v[7], v[100:120] = 0, 0, v[3]
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "key long, v array<double>")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "key long, v array<double>")
    monkeypatch.setattr(cells, "BLOCK", size)
    monkeypatch.setattr(cells, "COPIES", 0)
    for k in (1, 5, 300):
        got = {(x.key, x["rank"]): (x.ref, x.score) for x in cells.knn_topk(df, refs, k, 12).collect()}
        assert len(got) == 40 * min(k, 200)
        for i in range(40):
            s = np.array([(q[i] * x).sum() for x in v])
            for rank, j in enumerate(np.lexsort((np.arange(200), -np.round(s, 9)))[:k], 1):
                assert got[i, rank] == (j, pytest.approx(s[j]))


def test_largest_inner_products_skip_cells(spark):
    v = _groups(np.random.default_rng(7), 4000, 24, 40, 0.05)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>")
    seen = []
    got = cells.knn_topk(df.where("key % 40 = 0"), df.where("key % 40 <> 0"), 5, 80, looked_at=seen)
    assert got.count() == 500 and sum(seen) < 0.15 * 100 * 3900


@pytest.mark.parametrize("limit,numbers", [(20_000, 1 << 23), (3, 1 << 23), (20_000, 10)])
def test_two_nearest_centroids(spark, monkeypatch, limit, numbers):
    """As a matrix in every task and, beyond the limits, in cells: ties, repeated keys and nulls."""
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", numbers)
    g = np.random.default_rng(4)
    v, c = g.normal(size=(50, 5)), g.normal(size=(7, 5))
    c = np.concatenate((c, c[[3, 5]]))
    labels = ["g", "f", "e", "d", "c", "b", "a", "A", "z"]
    rows = [(i % 20, x.tolist()) for i, x in enumerate(v)] + [(99, None), (None, [1.0] * 5), (98, [float("nan")] * 5), (97, [1.0])]
    q = spark.createDataFrame(rows, "key long, v array<double>")
    refs = spark.createDataFrame([(n, x.tolist()) for n, x in zip(labels, c)] + [(None, [50.0] * 5), ("null", None)], "label string, centroid array<double>")
    want = []
    for key, x in rows:
        if x is None or len(x) != 5 or np.isnan(x).any():
            want.append((key, None, None, None))
        else:
            s = np.round((np.array(x) * c).sum(axis=1), 9)
            o = sorted(range(9), key=lambda i: (-s[i], labels[i]))
            want.append((key, labels[o[0]], s[o[0]], s[o[1]]))
    got = [(x.key, x.best_label, *(None if y is None else round(y, 9) for y in (x.best_score, x.second_score))) for x in neighbors.top2(q, refs, "key", "v", "label").collect()]
    assert sorted(map(str, got)) == sorted(str((a, b, *(None if y is None else round(float(y), 9) for y in z))) for a, b, *z in want)
    assert neighbors.top2(q, refs.where("label = 'g'"), "key", "v", "label").where("second_score is null").count() == len(rows)
    assert neighbors.top2(q, refs.where("false"), "key", "v", "label").count() == 0
