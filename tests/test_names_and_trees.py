"""Fuzzy names against all pairs, and agglomeration against joining one pair at a time."""

import difflib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import agglomerate, names, neighbors


def _score(a, b, sequence):
    x, y = set(a.split(" ")), set(b.split(" "))
    held = (min(len(a), len(b)) / max(len(a), len(b)) if a or b else 1) if a in b or b in a else 0
    return round(100 * max(len(x & y) / len(x | y), held, difflib.SequenceMatcher(None, a, b).ratio() if sequence else 0), 4)


def _names(g, n):
    parts = ["cat", "catnip", "drake", "darke", "hot", "line", "hotline", "boy", "friend", "a", "xy", "distracted", "boyfriend", "é", "the", "the", "the"]
    out = {"", "a", "zz", "cat", "qqq www"}
    while len(out) < n:
        x = " ".join(g.choice(parts, g.integers(1, 5)))
        if g.random() < 0.3:
            i = int(g.integers(0, len(x)))
            x = x[:i] + "abcdefgh"[int(g.integers(0, 8))] + x[i + 1 :]
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("sequence,n", [(False, 1000), (True, 500)])
def test_best_names_are_those_of_all_pairs(spark, sequence, n):
    every = _names(np.random.default_rng(1), n + 60)
    q, c = every[::17], [x for i, x in enumerate(every) if i % 17 or i < 40]
    queries = spark.createDataFrame([(x,) for x in [*q, q[0], None]], "name string")
    candidates = spark.createDataFrame([*enumerate(c), (5000, None), (None, "cat")], "row_id long, name string")
    for k in (1, 4):
        got = {}
        for x in neighbors.fuzzy_match_topk(queries, candidates, k, sequence).collect():
            got.setdefault(x.query, []).append((x["rank"], x.row_id, x.score))
        for a in set(q):
            best = sorted(((-_score(a, b, sequence), -i) for i, b in enumerate(c)))[:k]
            assert sorted(got[a]) == [(r, -i, -s) for r, (s, i) in enumerate(best, 1)], a
        assert len(got) == len(set(q))
    assert neighbors.fuzzy_match_topk(queries, candidates.limit(2), 4, sequence).groupBy("query").count().where("count <> 2").count() == 0
    assert neighbors.fuzzy_match_topk(queries, candidates.where("false"), 4, sequence).count() == 0


def test_names_within_others(spark):
    every = _names(np.random.default_rng(2), 200)
    n, c = every[::3], every[1::3]
    got = {x.name: x.found for x in names.containing_name(spark.createDataFrame([(x,) for x in n], "name string"), spark.createDataFrame([(x,) for x in c], "name string")).collect()}
    want = {a: min((b for b in c if f" {a} " in f" {b} "), default=None) for a in n}
    assert got == {a: b for a, b in want.items() if b is not None}


def test_cosines_of_names(spark):
    every = _names(np.random.default_rng(3), 150)
    df = spark.createDataFrame(list(enumerate(every)), "id long, name string")
    sets = [set(x.split(" ")) for x in every]
    cosine = {(a, b): len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) for a, b in itertools.combinations(range(len(every)), 2)}
    for least in (0.5, 0.8, 1.0):
        got = {(x.a, x.b): x.cosine for x in names.cosine_pairs(df, least).collect()}
        assert got == pytest.approx({k: v for k, v in cosine.items() if v >= least - 1e-12})


def _one_at_a_time(d, linkage, most=math.inf, clusters=1):
    """Plain agglomeration of a matrix of (squared) distances: groups of indexes."""
    groups = [[i] for i in range(len(d))]

    def height(a, b):
        s = sum(d[i][j] for i in a for j in b)
        if linkage == "average":
            return s / len(a) / len(b)
        w = [sum(d[i][j] for i, j in itertools.combinations(x, 2)) / len(x) ** 2 for x in (a, b)]
        return (s / len(a) / len(b) - sum(w)) * len(a) * len(b) / (len(a) + len(b))

    while len(groups) > clusters:
        h, i, j = min((height(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if h > most:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(x) for x in groups)


def test_ward_clusters(spark):
    v = np.random.default_rng(4).normal(size=(40, 3))
    df = spark.createDataFrame([(f"k{i:02d}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "key string, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    for k in (1, 4):
        got = {x.key: x.cluster for x in agglomerate.ward_clusters(df, "key", "v", k).collect()}
        groups = sorted(sorted(int(i[1:]) for i, c in got.items() if c == n) for n in range(k))
        assert groups == _one_at_a_time(d, "ward", clusters=k) and got["none"] is None


def test_average_linkage_up_to_a_distance(spark):
    g = np.random.default_rng(5)
    d = g.uniform(0, 1, (30, 30))
    d = np.round((d + d.T) / 2, 6)
    ids = spark.range(30)
    pairs = [(a, b, float(d[a, b])) for a, b in itertools.combinations(range(30), 2)]
    every = spark.createDataFrame(pairs, "a long, b long, value double")
    joins = agglomerate.merges(ids, every, "average", 0.3)
    got = {}
    for x in agglomerate.cut(ids, joins).collect():
        got.setdefault(x.cluster, []).append(x.id)
    want = _one_at_a_time(d, "average", 0.3)
    assert sorted(sorted(x) for x in got.values()) == want and 3 < len(want) < 30
    near = every.where("value <= 0.3")
    inside = agglomerate.pairs_of_components(ids, near).join(every, ["a", "b"])
    again = agglomerate.cut(ids, agglomerate.merges(ids, inside, "average", 0.3)).withColumnRenamed("cluster", "c")
    assert again.join(agglomerate.cut(ids, joins), "id").where(F.col("c") != F.col("cluster")).count() == 0
    assert agglomerate.merges(ids, every.where("false"), "average").count() == 0
