"""Edge cases on small tables."""

import datetime as dt
import difflib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as sc
from lattica.operators import affect, cluster, neighbors, ordered, popularity, relational, statistics
from lattica.plans.registry import QUERIES
from lattica.sources import ingest
from lattica.streaming import streams


def test_dominant_takes_the_first_label_on_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, None), (2, None, None, None), (3, 0.1, None, 0.4)], "k int, a double, b double, c double")
    label, score = sc.dominant({"a": "a", "b": "b", "c": "c"})
    rows = df.select("k", label.alias("l"), score.alias("s")).orderBy("k").collect()
    assert [(r.l, r.s) for r in rows] == [("a", 0.5), ("unavailable", None), ("c", 0.4)]


def test_gap_filled_curve_keeps_the_posts_and_finds_runs(spark):
    t = [dt.datetime(2024, m, 3) for m in (1, 1, 2, 6)]
    posts = spark.createDataFrame([("a", x) for x in t] + [("b", dt.datetime(2024, 8, 1))], "template_key string, created_utc timestamp")
    curve = popularity.lifecycle_curve(posts)
    a = curve.where("template_key = 'a'")
    assert a.agg(F.sum("posts"), F.count("*")).first() == (4, 8)
    runs = popularity.runs_islands(a).first()
    assert (runs.active_runs, runs.reactivations, runs.longest_zero_run) == (2, 1, 3)
    e = popularity.lifecycle_events(a, sustain=2, zero_run=3).first()
    assert e.expiry == dt.datetime(2024, 5, 1) and e.active_periods == 3


def test_repeated_key_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        relational.assert_unique(df, ["k"]).collect()


def test_split_covers_rows_once_and_every_class(spark):
    df = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 7).alias("label"))
    rows = ordered.stratified_split(df, "label", "key", 0.2, 1).collect()
    assert len(rows) == 200 and {r.label for r in rows if r.split == "test"} == set(range(7))


@pytest.mark.parametrize("bands", [None, 9, 5, 3])
def test_banded_radius_join_is_exact(spark, bands):
    values = [(i, (i * 0x9E3779B97F4A7C15) % 2**64 - 2**63) for i in range(40)] + [(100 + i, 3 ^ (1 << i)) for i in range(12)] + [(200, -1), (201, -1 ^ 255)]
    df = spark.createDataFrame(values, "key long, hash long")
    r = 8 if bands != 5 else 4
    got = {(x.a, x.b) for x in neighbors.radius_join_hamming(df, df, r, bands=bands).collect()}
    want = {(a, b) for a, x in values for b, y in values if bin((x ^ y) & (2**64 - 1)).count("1") <= r}
    assert got == want


def test_silhouette_is_that_of_all_pairs(spark):
    g = np.random.default_rng(5)
    v, c = g.normal(size=(60, 3)), g.integers(0, 4, 60)
    c[0] = 9  # a cluster of one row
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, c))], "key long, v array<double>, cluster int")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    s = []
    for i in range(60):
        mean = {k: d[i, (c == k) & (np.arange(60) != i)].mean() for k in set(c.tolist()) if ((c == k) & (np.arange(60) != i)).any()}
        near = min(x for k, x in mean.items() if k != c[i])
        s.append((near - mean[c[i]]) / max(near, mean[c[i]]) if c[i] in mean else 0.0)
    assert cluster.silhouette(df, "key", "v", block=20).first()[0] == pytest.approx(np.mean(s))


def _same_groups(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_clusterings_find_separate_groups(spark):
    g = np.random.default_rng(6)
    rows = [(i, (np.eye(3)[i % 3] * 20 + g.normal(size=3)).tolist()) for i in range(90)]
    df = cluster.vectorised(spark.createDataFrame(rows, "key long, v array<double>"), "v")
    for method in (cluster.kmeans, cluster.gmm, cluster.bisecting):
        got = method(df, 3).orderBy("key").collect()
        assert len(got) == 90 and _same_groups([x.cluster for x in got], [i % 3 for i in range(90)])
    named = cluster.relabelled(cluster.kmeans(df, 3), F.min("key")).collect()
    assert {(x.key % 3, x.cluster) for x in named} == {(0, 0), (1, 1), (2, 2)}


def test_warped_clusters(spark):
    """The cost is that of the plain recursion, and shifted peaks fall together."""
    g = np.random.default_rng(7)
    for _ in range(20):
        a, b = g.normal(size=g.integers(1, 9)), g.normal(size=g.integers(1, 9))
        c = np.full((len(a) + 1, len(b) + 1), np.inf)
        c[0, 0] = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                c[i + 1, j + 1] = (x - y) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
        cost, path = cluster._dtw(a, b)
        assert cost == pytest.approx(c[-1, -1]) and sum((a[i] - b[j]) ** 2 for i, j in path) == pytest.approx(cost)
    shapes = [np.eye(20)[3 + i % 5] * 9 if i % 2 else np.where(np.arange(20) > 4 + i % 5, 9.0, 0.0) for i in range(24)]
    curves = spark.createDataFrame([(f"t{i:02}", x.tolist()) for i, x in enumerate(shapes)], "template_key string, curve array<double>")
    got = cluster.dtw_kmeans(curves, 2, starts=4).orderBy("template_key").collect()
    assert len(got) == 24 and _same_groups([x.cluster for x in got], [i % 2 for i in range(24)])
    assert cluster.dtw_kmeans(curves.where("false"), 2, starts=2).count() == 0


def test_names_of_clusters(spark):
    g = np.random.default_rng(8)
    names = ["evergreen", "bursty", "faded"]
    for n in (2, 3, 5):
        s = g.normal(size=(n, 3))
        profiles = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "cluster int, score_evergreen double, score_bursty double, score_faded double")
        got = {x.cluster: x["name"] for x in cluster.cluster_naming(profiles, names).collect()}
        k = min(n, 3)
        best = max((sum(s[c, m] for c, m in zip(cs, ms)), dict(zip(cs, ms))) for cs in itertools.combinations(range(n), k) for ms in itertools.permutations(range(3), k))[1]
        assert got == {i: names[best[i]] if i in best else f"cluster_{i}" for i in range(n)}
    manual = cluster.cluster_naming(profiles, names, "0 = Bursty, 3=faded").collect()
    assert {x.cluster: x["name"] for x in manual} == {0: "bursty", 1: "cluster_1", 2: "cluster_2", 3: "faded", 4: "cluster_4"}
    with pytest.raises(ValueError):
        cluster.manual_names("1=other", names)


def test_profiles_and_representatives(spark):
    g = np.random.default_rng(9)
    rows = [(f"t{i:02}", i % 3, g.normal(size=2).round(1).tolist(), int(g.integers(1, 6))) for i in range(40)]
    df = spark.createDataFrame(rows, "template_key string, cluster int, v array<double>, posts long")
    flat = df.select("cluster", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    p = {r.cluster: r for r in cluster.cluster_profiles(flat, ["x", "y"], {"up": {"x": 2.0, "y": -1.0, "z": 5.0}}).collect()}
    got = {(r.cluster, r.place): r.template_key for r in cluster.representatives(df, "template_key", "posts", 3).collect()}
    for k in range(3):
        own = [r for r in rows if r[1] == k]
        m = np.mean([r[2] for r in own], axis=0)
        assert (p[k].size, p[k].x, p[k].score_up) == (len(own), pytest.approx(m[0]), pytest.approx(2 * m[0] - m[1]))
        d = [round(float(np.linalg.norm(np.array(r[2]) - m)), 9) for r in own]
        far, large = sorted(set(d)), sorted({r[3] for r in own}, reverse=True)
        order = sorted((1 + far.index(x) + 0.65 * (1 + large.index(r[3])), r[0]) for x, r in zip(d, own))
        assert [got[k, i] for i in (1, 2, 3)] == [name for _, name in order[:3]]


def test_reduction_is_that_of_the_singular_vectors(spark):
    g = np.random.default_rng(10)
    v = g.normal(size=(50, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7
    out = cluster.pca_reduce(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>"), "v", 3).collect()
    centred = v - v.mean(axis=0)
    p = centred @ np.linalg.svd(centred)[2][:3].T
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert all(np.abs(x.reduced) == pytest.approx(np.abs(p[x.key]), abs=1e-6) for x in out)


def test_a_batch_tried_again_replaces_its_output(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("key"), F.col("id").alias("seq"))
    write = streams._batch_writer(str(tmp_path / "w"), lambda x, number: x)
    for number in (0, 1, 1, 0):
        write(df.withColumn("n", F.lit(number)), number)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10


def test_rank_tests_of_all_pairs(spark):
    """U, ties and distances over many range partitions, against counting pairs."""
    g = np.random.default_rng(12)
    rows = [(["x", "y", "z", "w"][int(g.integers(0, 4))], float(v)) for v in g.normal(size=300).round(1)] + [("one", 0.3), (None, 1.0), ("x", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    of = {k: np.array([v for h, v in rows if h == k and v is not None]) for k in ("x", "y", "z", "w", "one")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.a, r.b): r for r in statistics._group_pairs(df, "g", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(itertools.combinations(sorted(of), 2))
    for (a, b), r in got.items():
        x, y = of[a], of[b]
        both = np.unique(np.concatenate((x, y)), return_counts=True)
        assert (r.na, r.nb, r.u, r.ties) == (len(x), len(y), (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2, (both[1] ** 3).sum())
        assert r.d == pytest.approx(max(abs((x <= v).mean() - (y <= v).mean()) for v in both[0]))


def test_first_row_of_a_name_stays(spark, tmp_path):
    (tmp_path / "b.csv").write_text("n,v\nx,1\ny,2\n")
    (tmp_path / "a.csv").write_text("n,v\nx,9\n,3\nx,0\nz,4\n")
    got = ingest.read_csv_typed(spark, str(tmp_path), ["n", "v"], "n").orderBy("row_id").collect()
    assert [(r.n, r.v, r.row_id) for r in got] == [("x", "9", 1), ("y", "2", 2), ("z", "4", 3)]


@pytest.mark.parametrize("name", ["batch_assign_pipeline", "multinomial_logreg", "temporal_clusters", "kmeans_curves", "cluster_robustness"])
def test_queries_without_sql(spark, name):
    d = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, d).collect()
    if name == "batch_assign_pipeline":
        keys = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
        assert {r.key for r in rows} == keys and len(rows) == len(keys)
        new = [r for r in rows if r.source == "prediction"]
        assert {r.key for r in new} == {k for k in keys if k % 5 == 0}
        assert all(r.accepted == (r.best_score >= 0.25 and (r.margin is None or r.margin >= 0.02)) or abs(r.best_score - 0.25) < 1e-3 or abs(r.margin - 0.02) < 1e-3 for r in new)
        assert all(r.label == -1 for r in new if not r.accepted) and all(-1.001 <= r.a_best_score <= 1.001 for r in new)
    elif name == "multinomial_logreg":
        assert all(0.25 <= r.confidence <= 1 for r in rows) and sum(r.predicted == r["class"] for r in rows) > 0.9 * len(rows)
    elif name == "temporal_clusters":
        first = [min(r.month for r in rows if r.cluster == k) for k in sorted({r.cluster for r in rows})]
        assert first == sorted(first) and len({r.month for r in rows}) == len(rows)
    elif name == "kmeans_curves":
        assert len({r.template_key for r in rows}) == len(rows) and {r.cluster for r in rows} == set(range(4))
    else:
        sizes = {k: sum(r["size"] for r in rows if r.k == k) for k in (3, 4, 5)}
        assert len(set(sizes.values())) == 1 and all(abs(sum(r["size"] * r.active_ratio for r in rows if r.k == k)) < 1e-2 * sizes[k] for k in sizes)


def test_jensen_shannon_is_one_for_disjoint_distributions(spark):
    df = spark.createDataFrame([("x", "p", 1), ("y", "q", 3), ("z", "p", 2)], "g string, c string, n int")
    got = {(r.a, r.b): r.distance for r in affect.jensen_shannon(df, "g", "c", "n", 2.0).collect()}
    assert got[("x", "y")] == pytest.approx(1.0) and got[("x", "z")] == pytest.approx(0.0)


def test_chi_square_survival_has_known_values():
    assert statistics.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05)
    assert statistics.chi2_survival(7.814727903251179, 3) == pytest.approx(0.05)
    assert statistics.chi2_survival(9.487729036781154, 4) == pytest.approx(0.05)


def test_value_ranks_agree_with_a_window(spark):
    df = spark.range(300).select((F.col("id") * 7 % 90).alias("v"))
    ranks = {r.v: r["rank"] for r in statistics.value_ranks(df, "v").collect()}
    values = sorted(r.v for r in df.collect())
    assert all(ranks[v] == pytest.approx(values.index(v) + (values.count(v) + 1) / 2) for v in set(values))


def test_metrics_of_a_perfect_prediction(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "t int, p int")
    m = cluster.classification_metrics(df, "t", "p").first()
    assert (m.accuracy, m.macro_f1, m.mcc, m.kappa) == (1.0, 1.0, 1.0, 1.0)


def test_annotations_skip_bad_lines(spark):
    lines = ['{"key": 7, "data": {"template": "t"}}', "", "{broken", '{"key": 8, "data": [1]}', '{"key": 9}']
    rows = ingest.parse_annotations(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.key, r.template_original) for r in rows] == [("7", "t")]


def test_components_join_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    nodes = spark.range(23)
    got = {r.id: r.component for r in cluster.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(21)} | {21: 21, 22: 22}


def test_entropy_is_null_with_a_missing_score(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, None), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(sc.score_entropy("a", "b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1:] == [None, None] and math.isfinite(got[0])


def test_hamming_nearest_has_no_largest_number_of_references(spark):
    r = np.random.default_rng(3)
    q, g = r.integers(0, 1 << 12, 300), r.integers(-(1 << 62), 1 << 62, 20_500)
    g[:400] = r.integers(0, 1 << 12, 400)  # near ones, with ties
    ids = r.permutation(len(g))
    d = np.bitwise_count((q[:, None] ^ g[None, :]).view(np.uint64))
    want = {i: min(zip(x.tolist(), ids.tolist())) for i, x in enumerate(d)}
    queries = spark.createDataFrame([*enumerate(q.tolist()), (900, None)], "key long, hash long")
    references = spark.createDataFrame([*zip(ids.tolist(), g.tolist()), (-5, None)], "key long, hash long")
    want[900] = (None, -5)
    got = {x.key: (x.distance, x.ref) for x in neighbors.hamming_nearest(queries, references).collect()}
    assert got == want
    assert neighbors.hamming_nearest(queries, references.where("false")).count() == 0
