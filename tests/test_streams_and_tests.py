"""Upserted streams, late rows, and p-values of rank tests against plain versions."""

import datetime as dt
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import affect, statistics
from lattica.streaming import streams


def _stream(spark, path, batches, schema):
    """A stream of one file a batch, in order."""
    for i, rows in enumerate(batches):
        folder = f"{path}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        file = next(x for x in os.listdir(folder) if x.endswith(".parquet"))
        os.makedirs(path, exist_ok=True)
        os.rename(f"{folder}/{file}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_upserts_write_only_the_buckets_they_touch(spark, tmp_path):
    r = np.random.default_rng(1)
    batches = [[(k, k, "first") for k in range(40)], [(7, 50, "new")], [(7, 49, "late"), (100, 1, "more"), (None, 3, "null")], [(int(k), 60 + int(k), "last") for k in r.integers(0, 40, 6)]]
    stream = _stream(spark, str(tmp_path / "s"), batches, "key long, seq long, v string")
    want = {}
    for k, s, v in itertools.chain(*batches):
        if k not in want or s > want[k][0]:
            want[k] = (s, v)
    path = str(tmp_path / "t")
    seen = []
    for run in range(2):  # the second run has a new checkpoint, so every batch is tried again
        t = streams.stream_upsert(spark, stream, "key", "seq", path, str(tmp_path / f"c{run}"), 16)
        assert sorted(((x.key, x.seq, x.v) for x in t.collect()), key=str) == sorted(((k, *x) for k, x in want.items()), key=str)
        folders = [sorted(x for x in os.listdir(f"{path}/data/batch={b}") if x.startswith("bucket=")) for b in range(4)]
        seen.append(folders)
        assert len(folders[0]) > 10 and len(folders[1]) == 1 and len(folders[2]) <= 3
    assert seen[0] == seen[1]
    assert {len(os.listdir(f"{path}/manifest")), *(streams._manifest(spark, path, n).__len__() == 0 for n in (0,))} == {4, True}
    # A batch whose manifest is not whole is not seen.
    os.remove(f"{path}/manifest/batch=3/_SUCCESS")
    before = {x.key: x.v for x in streams.read_upserted(spark, path, stream).collect()}
    assert set(before.values()) == {"first", "new", "more", "null"}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    batches = [[(day(1), "a"), (day(2), "a")], [(day(20), "a")], [(day(20), "c")], [(day(2), "a"), (day(19), "b"), (day(20), "a")], [(day(25), "b")]]
    stream = _stream(spark, str(tmp_path / "s"), batches, "ts timestamp, kind string")
    v = streams.drained(streams.stream_volume(stream, "ts", "kind", late="2 days"), ["period", "kind"], str(tmp_path / "o"), str(tmp_path / "c"))
    got = {(x.period.day, x.kind): x.n for x in v.collect()}
    assert got == {(1, "a"): 1, (2, "a"): 1, (20, "a"): 2, (19, "b"): 1, (20, "c"): 1, (25, "b"): 1}


def _orders(a, b):
    for x in itertools.combinations(range(a + b), a):
        yield set(x)


@pytest.mark.parametrize("a,b", [(1, 1), (3, 4), (5, 2), (4, 6)])
def test_exact_p_values_are_shares_of_orders(a, b):
    us, ds = [], []
    for x in _orders(a, b):
        us.append(sum(sum(j < i for j in range(a + b) if j not in x) for i in x))
        fa = fb = 0
        ds.append(max(abs((fa := fa + (i in x)) * b - (fb := fb + (i not in x)) * a) for i in range(a + b)))
    assert statistics.rank_sum_counts(a, b) == [us.count(u) for u in range(a * b + 1)]
    for u in range(a * b + 1):
        p = 2 * sum(x >= max(u, a * b - u) for x in us) / len(us)
        assert statistics.rank_sum_p(u, a, b, 9.9, False) == pytest.approx(min(1, p))
    for d in set(ds):
        assert statistics.ks_p(d / (a * b), a, b) == pytest.approx(sum(x >= d for x in ds) / len(ds))


def test_known_p_values():
    # 2 / 252 of the orders of five and five rows are as extreme as all of one group above the other.
    assert statistics.rank_sum_p(25.0, 5, 5, None, False) == pytest.approx(2 / 252)
    assert statistics.ks_p(1.0, 5, 5) == pytest.approx(2 / 252)
    assert statistics.kolmogorov_tail(1.3580986) == pytest.approx(0.05, abs=1e-6)
    assert statistics.kolmogorov_tail(0.5) == pytest.approx(0.9639452436, abs=1e-9)
    assert statistics.kolmogorov_tail(1 - 1e-12) == pytest.approx(statistics.kolmogorov_tail(1.0), abs=1e-9)
    assert statistics.ks_p(1.0, 20_000, 20_000) < 1e-300 and statistics.ks_paths_p(0.0, 3, 3) == 1
    assert statistics.ks_paths_p(0.05, 3000, 3000) == pytest.approx(statistics.kolmogorov_tail(0.05 * math.sqrt(1500)), rel=0.05)
    assert statistics.rank_sum_p(4.0, 3, 3, None, True) is None
    assert statistics.rank_sum_p(4.0, 30, 30, 1.959963984540054, False) == pytest.approx(0.05)


def test_pairs_of_groups_have_means_medians_and_p(spark):
    rows = [("x", 1.0), ("x", 2.0), ("x", 10.0), ("y", 3.0), ("y", 4.0), ("y", 5.0), ("y", 6.0), ("z", 1.0), (None, 1.0), ("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    m = {(r.a, r.b): r for r in statistics.with_rank_sum_p(statistics.mann_whitney(df, "g", "v")).collect()}
    r = m["x", "y"]
    assert (r.u, r.tied, r.mean_a, r.median_a, r.mean_b, r.median_b) == (4.0, False, pytest.approx(13 / 3), 2.0, 4.5, 4.5)
    assert r.p_value == pytest.approx(2 * sum(statistics.rank_sum_counts(3, 4)[8:]) / 35) and m["x", "z"].tied
    k = {(r.a, r.b): r for r in statistics.with_ks_p(statistics.ks_two_sample(df, "g", "v")).collect()}
    assert k["x", "y"].d == pytest.approx(2 / 3) and k["x", "y"].p_value == pytest.approx(statistics.ks_paths_p(2 / 3, 3, 4))


@pytest.mark.parametrize("within", [None, "c"])
def test_distances_of_distributions(spark, within):
    g = np.random.default_rng(3)
    rows = [(int(g.integers(0, 2)), f"g{g.integers(0, 6)}", f"t{g.integers(0, 9)}", int(g.integers(0, 4))) for _ in range(60)] + [(1, "none", "t0", 0), (1, None, "t1", 2), (1, "g1", None, 5), (0, "alone", "own", 3)]
    df = spark.createDataFrame(rows, "c int, g string, t string, n int")
    sums = {}
    for c, k, t, n in rows:
        if k is not None and t is not None and n:
            own = sums.setdefault((c if within else 0, k), {})
            own[t] = own.get(t, 0) + n
    want = {}
    for (c, a), (e, b) in itertools.combinations(sorted(sums), 2):
        if c == e and a != b:
            p, q = ({t: n / sum(x.values()) for t, n in x.items()} for x in (sums[c, a], sums[e, b]))
            js = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in ((p.get(t, 0), q.get(t, 0)) for t in {*p, *q})) / 2
            want[c, a, b] = math.sqrt(max(js, 0))
    got = {(r.c if within else 0, r.a, r.b): r.distance for r in affect.jensen_shannon(df, "g", "t", "n", 2.0, within).collect()}
    assert got == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()}
