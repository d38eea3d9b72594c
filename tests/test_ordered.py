"""Ranks, medians and seeded splits of groups of any size, against plain versions."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import ordered, relational
from lattica.operators.statistics import roc_gmean_threshold, spearman


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(r.choice(["hot", "hot", "b", "c", None]), r.choice([float(r.randrange(5)), r.random() * 9, 7.0]), r.choice([None, float(r.randrange(4))])) for _ in range(600)]
    return out + [("none", None, None), ("one", 3.0, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    x = spark.createDataFrame([(i, g, *v) for i, (g, *v) in enumerate(rows)], "key long, g string, x double, y double")
    return x.withColumns({c: F.lit("extra") for c in ("c", "n", "rank", "part")}).repartition(5)


def test_group_medians(df, rows):
    values = defaultdict(lambda: ([], []))
    for g, x, y in rows:
        for held, v in zip(values[g], (x, y)):
            if v is not None:
                held.append(v)
    got = {r.g: (r.median_x, r.median_y) for r in ordered.with_medians(df.groupBy("g").agg(F.count("*").alias("posts")), df, ["g"], ["x", "y"]).collect()}
    want = {g: tuple(statistics.median(v) if v else None for v in held) for g, held in values.items()}
    assert got == {g: pytest.approx(v) for g, v in want.items()}
    assert ordered.group_medians(df.where("false"), ["g"], ["x"]).collect() == []


def test_percentiles(df, rows):
    p = pd.DataFrame(rows, columns=["g", "x", "y"])
    want = p.groupby("g", dropna=False)["x"].rank(pct=True)
    got = {r.key: r.pct for r in ordered.with_pct_rank(df, ["g"], "x", "pct").select("key", "pct").collect()}
    assert len(got) == len(rows)
    assert all((got[i] is None and pd.isna(w)) or got[i] == pytest.approx(w) for i, w in want.items())


def test_prefix_sums_of_one_group(df, rows):
    p = {r.x: r for r in ordered.prefix_sums(df, [], "x", {"k": F.count("*")}).collect()}
    values = Counter(x for _, x, _ in rows if x is not None)
    assert {x: r.k for x, r in p.items()} == values
    assert all(r.before_k == sum(n for y, n in values.items() if y < x) and r.all_k == sum(values.values()) for x, r in p.items())


def test_roc_threshold(spark):
    r = random.Random(2)
    rows = [(r.randrange(2), r.choice([None, *[i / 10 for i in range(11)]])) for _ in range(300)]
    got = roc_gmean_threshold(spark.createDataFrame(rows, "label int, score double"), "label", "score").first()
    known = [(y, s) for y, s in rows if s is not None]
    best = max(((sum(y for y, s in known if s >= t) / sum(y for y, _ in known) * (1 - sum(1 - y for y, s in known if s >= t) / sum(1 - y for y, _ in known))) ** 0.5, t) for t in {s for _, s in known})
    assert (got.gmean, got.threshold) == (pytest.approx(best[0]), best[1])


def test_rank_correlations(spark):
    r = random.Random(4)
    rows = [(r.choice([None, r.randrange(6) * 1.0, r.random()]), r.choice([None, float(r.randrange(9))]), 5.0, r.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, a double, b double, c double").repartition(4)
    got = {m.metric: m.rho for m in spearman(df, "x", ["a", "b", "c"]).collect()}
    p = pd.DataFrame(rows, columns=["x", "a", "b", "c"])
    for m in "ac":
        known = p[["x", m]].dropna().rank()
        assert got[m] == pytest.approx(known["x"].corr(known[m]))
    assert got["b"] is None
    assert [x.rho for x in spearman(df.where("x is not null and a is not null").limit(2), "x", ["a"]).collect()] == [None]


@pytest.mark.parametrize("size", [1, 20, 4096])
def test_seeded_split_and_sample(df, rows, monkeypatch, size):
    monkeypatch.setattr(ordered, "RANGE", size)
    place = defaultdict(list)
    for i, (g, *_) in enumerate(rows):
        place[g].append((hashlib.md5(f"{i}|42".encode()).hexdigest(), i))
    rank = {i: (r, len(held)) for held in place.values() for r, (_, i) in enumerate(sorted(held), 1)}
    got = {x.key: (x.split, x.fold) for x in ordered.stratified_split(df, "g", "key", 0.2, 42).collect()}
    for i, (r, n) in rank.items():
        test = r <= min(max(int(n * 0.2 + 0.5), 1), n - 1)
        assert got[i] == ("test" if test else "train", r % 5)
    picked = [x.key for x in ordered.stratified_sample(df, "g", "key", 50, 42).collect()]
    own = {i: (rank[i][0] > max(1, int(rank[i][1] * 50 / len(rows) + 0.5)), rank[i][0] > 1, hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i in rank}
    assert picked == sorted(own, key=own.get)[:50]


def test_lookup_of_frequent_keys(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id")).cast("long").alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("rows"), F.min("id").alias("first")).where("k is null or k < 4000")
    for count, t in (("rows", table), (None, table.drop("rows"))):
        got = relational.spread_lookup(rows, t, ["k"], "left", count)
        assert got.columns == ["id", "k", "first"]
        assert got.count() == 5000 and got.where("first is null").agg(F.min("k")).first()[0] == 4001
        assert relational.spread_lookup(rows, t, ["k"], "inner", count).where("first <= id").count() == 5000 - got.where("first is null").count()
