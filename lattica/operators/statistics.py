"""Rank tests, contingency tables, corrections and shares.

Test statistics are plans over the rows; p-values are computed by Spark expressions on the
result, from the normal tail and the chi-square survival function for whole degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .affect import jensen_shannon
from .ordered import prefix_sums, suffix_minima, value_ranks, with_medians
from .relational import checkpointed, spread_lookup


def share_grid(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Counts and shares of every category in every group, 0 included."""
    n = rows.groupBy(group, category).agg(F.count("*").alias("n"))
    grid = n.select(group).distinct().crossJoin(n.select(category).distinct())
    full = grid.join(n, [group, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(group)), 6))


def spearman(rows: DataFrame, engagement: str, metrics: Sequence[str]) -> DataFrame:
    """Rank correlation with every metric; null below three rows or for a constant.

    Rows are counted by metric and both values, and ranks come from the counts of distinct values, so
    that no task orders the rows of a metric."""
    long = rows.select(F.col(engagement).alias("x"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics))).alias("m")).select("x", "m.*").where("x is not null and y is not null")
    cells = checkpointed(long.groupBy("metric", "x", "y").agg(F.count("*").alias("k")))
    ranks = []
    for v in "xy":
        p = prefix_sums(cells, ["metric"], v, {"k": F.sum("k")})
        ranks.append(p.select("metric", v, (F.col("before_k") + (F.col("k") + 1) / 2 - (F.col("all_k") + 1) / 2).alias(f"r{v}")))  # less the mean rank
    placed = cells.join(ranks[0], ["metric", "x"]).join(ranks[1], ["metric", "y"])

    def total(c: Column) -> Column:
        return F.sum(F.col("k") * c)

    sums = placed.groupBy("metric").agg(F.sum("k").alias("n"), total(F.col("rx") * F.col("ry")).alias("xy"), total(F.col("rx") * F.col("rx")).alias("xx"), total(F.col("ry") * F.col("ry")).alias("yy"))
    return sums.select("metric", F.when((F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """H with the correction for ties, over groups of two rows at least.

    Ranks over all rows come from the counts of distinct values, so that no task sorts the rows.
    """
    big = rows.groupBy(group).count().where("count >= 2").select(group)
    x = rows.join(big, group, "left_semi").select(group, value)
    ranks = value_ranks(x, value)
    cells = x.groupBy(group, value).agg(F.count("*").alias("k"))
    sums = cells.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("k").alias("k"), F.sum(F.col("rank") * F.col("k")).alias("r"))
    ties = ranks.agg(F.sum(F.pow("c", 3) - F.col("c")).alias("t"))
    s = sums.agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("q"), F.count("*").alias("groups")).crossJoin(ties)
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return s.select(h.alias("h"), "groups", (F.col("groups") - 1).alias("dof"))


def _pair_sums(labels: list, sizes: np.ndarray):
    """Rows (part, group, value, n) sorted by value: for every two groups, what this partition adds to
    the pairs of rows, ties and distances of distribution functions; and its rows by group (b null)."""
    g, index = len(labels), {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, u, squares, cubes = np.zeros(g), np.zeros((g, g)), np.zeros((g, g)), np.zeros(g)
        hi, lo = np.full((g, g), -np.inf), np.full((g, g), np.inf)
        held, part = None, None

        def add(value, at, n) -> None:
            nonlocal below, u, squares, cubes
            number = np.cumsum(np.concatenate(([0], (value[1:] != value[:-1]).astype(int))))
            step = max(1, 1_000_000 // g)
            for lo_at in range(0, int(number[-1]) + 1, step):
                own = (number >= lo_at) & (number < lo_at + step)
                c = np.zeros((min(step, int(number[-1]) + 1 - lo_at), g))
                np.add.at(c, (number[own] - lo_at, at[own]), n[own])
                upto = below + np.cumsum(c, axis=0)
                u += c.T @ (upto - c / 2)
                squares += (c * c).T @ c
                cubes += (c**3).sum(axis=0)
                share = upto / sizes
                for i in range(g):
                    d = share[:, [i]] - share
                    np.maximum(hi[i], d.max(axis=0), out=hi[i])
                    np.minimum(lo[i], d.min(axis=0), out=lo[i])
                below = upto[-1]

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            rows = [b.column("value").to_numpy(zero_copy_only=False), np.array([index[x] for x in b.column("label").to_pylist()]), b.column("n").to_numpy().astype(float)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last value may go on
            if cut:
                add(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held is not None:
            add(*held)
        if part is not None:
            a, b = np.triu_indices(g, 1)
            none = np.full(g, np.nan)
            ties = cubes[a] + cubes[b] + 3 * squares[a, b] + 3 * squares[b, a]
            cols = {"a": np.concatenate((a, np.arange(g))), "u": np.concatenate((u[a, b], below)), "ties": np.concatenate((ties, none)), "hi": np.concatenate((hi[a, b], none)), "lo": np.concatenate((lo[a, b], none))}
            other = pa.array([*b.tolist(), *[None] * g], pa.int32())
            yield pa.record_batch([pa.array([part] * len(other), pa.int32()), pa.array(cols["a"], pa.int32()), other, *(pa.array(cols[x], pa.float64()) for x in ("u", "ties", "hi", "lo"))], names=["part", "a", "b", "u", "ties", "hi", "lo"])

    return run


def _group_pairs(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For every two groups (a before b): na, nb, u (pairs of rows in which a's is larger, ties half),
    ties (sum of the cubes of equal values' counts) and d, the largest distance of their distribution
    functions.

    Rows are counted by group and value and range-partitioned by value once for all pairs; a partition
    gives a few numbers a pair, and what lies below it comes from the partitions' sizes.  The driver
    holds the groups' names and sizes, and a task a few numbers for each pair of groups, as the result does.
    """
    spark = rows.sparkSession
    x = rows.select(F.col(group).alias("label"), F.col(value).cast("double").alias("value")).where("label is not null and value is not null")
    sizes = x.groupBy("label").agg(F.count("*").alias("size")).orderBy("label").collect()  # one row a group
    cells = x.groupBy("label", "value").agg(F.count("*").alias("n")).repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    run = _pair_sums([r.label for r in sizes], np.array([r["size"] for r in sizes], float))
    parts = cells.select("part", "label", "value", "n").mapInArrow(run, "part int, a int, b int, u double, ties double, hi double, lo double")
    parts = checkpointed(parts)
    inside = parts.where("b is null").select("part", "a", F.col("u").alias("n"))
    inside = inside.withColumn("before", F.sum("n").over(W.partitionBy("a").orderBy("part")) - F.col("n"))

    def side(name: str) -> DataFrame:
        return inside.select("part", F.col("a").alias(name), F.col("n").alias(f"n{name}"), F.col("before").alias(f"before_{name}"))

    names = spark.createDataFrame([(i, r.label, r["size"]) for i, r in enumerate(sizes)], f"i int, label {x.schema['label'].dataType.simpleString()}, size long")
    named = [names.select(F.col("i").alias(c), F.col("label").alias(f"label_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab"]
    p = parts.where("b is not null").join(side("a"), ["part", "a"]).join(side("b"), ["part", "b"]).join(F.broadcast(named[0]), "a").join(F.broadcast(named[1]), "b")
    apart = F.col("before_a") / F.col("size_a") - F.col("before_b") / F.col("size_b")
    d = F.greatest(F.abs(apart + F.col("hi")), F.abs(apart + F.col("lo")))
    u = F.sum(F.col("u") + F.col("na") * F.col("before_b"))
    return p.groupBy(F.col("label_a").alias("a"), F.col("label_b").alias("b")).agg(F.first("size_a").alias("na"), F.first("size_b").alias("nb"), u.alias("u"), F.sum("ties").alias("ties"), F.max(d).alias("d"))


def _described(pairs: DataFrame, rows: DataFrame, group: str, value: str) -> DataFrame:
    """The pairs (a, b) with the mean and median of both groups."""
    x = rows.select(F.col(group).alias("label"), F.col(value).cast("double").alias("value")).where("label is not null and value is not null")
    d = with_medians(x.groupBy("label").agg(F.avg("value").alias("mean")), x, ["label"], ["value"])
    for g in "ab":  # one row a group
        pairs = pairs.join(F.broadcast(d.select(F.col("label").alias(g), F.col("mean").alias(f"mean_{g}"), F.col("median_value").alias(f"median_{g}"))), g)
    return pairs


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group for every pair of groups, its effect size, z with the corrections for ties
    and continuity (null without any spread), whether values tie, and means and medians.  Rows without
    a group or value take no part."""
    s = _group_pairs(rows, group, value)
    na, nb = F.col("na"), F.col("nb")
    n = na + nb
    s = s.withColumn("rank_biserial", 2 * F.col("u") / (na * nb) - 1)
    sd = F.sqrt(na * nb / 12.0 * (n + 1 - (F.col("ties") - n) / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - na * nb / 2.0) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    s = s.select("a", "b", "na", "nb", "u", "rank_biserial", z.alias("z"), (F.col("ties") > n).alias("tied"))
    return _described(s, rows, group, value).select("a", "b", "na", "nb", "u", "rank_biserial", "z", "tied", "mean_a", "mean_b", "median_a", "median_b")


def ks_two_sample(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Largest distance of the two distribution functions for every pair of groups, with their means and
    medians."""
    s = _group_pairs(rows, group, value).select("a", "b", "d", "na", "nb")
    return _described(s, rows, group, value).select("a", "b", "d", "na", "nb", "mean_a", "mean_b", "median_a", "median_b")


def chi2_contingency(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square of the contingency table, with Yates' correction for one degree of freedom."""
    named = rows.select(F.coalesce(F.col(row).cast("string"), F.lit("unavailable")).alias("r"), F.coalesce(F.col(column).cast("string"), F.lit("unavailable")).alias("c"))
    grid = share_grid(named, "r", "c")
    total = F.sum("n").over(W.partitionBy())
    e = F.sum("n").over(W.partitionBy("r")) * F.sum("n").over(W.partitionBy("c")) / total
    cells = grid.select("r", "c", "n", e.alias("e"))
    s = cells.agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("plain"), F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("e")) - 0.5, F.lit(0.0)), 2) / F.col("e")).alias("yates"), ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("dof"), F.sum("n").alias("total"))
    return s.where("dof >= 1").select(F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), "dof", "total")


def bh_qvalues(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Benjamini and Hochberg's q-values; null p-values have none and are no tests.

    Tests of equal p have the q of the last of them, so distinct p-values are counted and ranked, and
    the least ratio from a p-value on is found within range partitions and over the later ones.  The
    ``key`` decides nothing.
    """
    c = prefix_sums(tests, [], p, {"c": F.count("*")})
    ratio = F.col(p) * F.col("all_c") / (F.col("before_c") + F.col("c"))
    least = suffix_minima(c.select(p, "c", ratio.alias("_ratio")), p, "_ratio")
    q = least.select(p, "c", F.least("_ratio", F.lit(1.0)).alias("q"))
    return spread_lookup(tests, q, [p], "left", "c")


def intra_cluster_distances(rows: DataFrame, cluster: str, entity: str, category: str, value: str) -> DataFrame:
    """Summary of the natural-log Jensen-Shannon distances between the entities of every cluster."""
    sizes = rows.groupBy(cluster, F.col(entity).alias("e")).agg(F.sum(value).alias("w"))
    d = jensen_shannon(rows, entity, category, value, math.e, cluster)
    d = d.join(sizes.select(cluster, F.col("e").alias("a"), F.col("w").alias("wa")), [cluster, "a"]).join(sizes.select(cluster, F.col("e").alias("b"), F.col("w").alias("wb")), [cluster, "b"])
    w = F.least("wa", "wb")
    s = d.groupBy(cluster).agg(F.count("*").alias("pairs"), F.avg("distance").alias("mean"), F.max("distance").alias("max"), (F.sum(F.col("distance") * w) / F.sum(w)).alias("weighted"))
    s = with_medians(s, d, [cluster], ["distance"]).withColumnRenamed("median_distance", "median")
    return s.select(cluster, "pairs", *(F.round(c, 6).alias(c) for c in ("mean", "median", "max", "weighted")))


def roc_gmean_threshold(rows: DataFrame, label: str, score: str) -> DataFrame:
    """The score with the largest geometric mean of true positive and true negative rates, from counts
    of the rows at and above every distinct score.  Null scores are left out."""
    v = prefix_sums(rows, [], score, {"p": F.sum(label), "n": F.count("*") - F.sum(label)})
    tpr, fpr = ((F.col(f"all_{c}") - F.col(f"before_{c}")) / F.nullif(F.col(f"all_{c}"), F.lit(0)) for c in "pn")
    g = F.sqrt(tpr * (1 - fpr))
    return v.agg(F.max(F.struct(g.alias("gmean"), F.col(score).alias("s"))).alias("b")).select(F.col("b.s").alias("threshold"), F.col("b.gmean").alias("gmean"))


def _map_result(df: DataFrame, of: Sequence[str], f, name: str = "p_value") -> DataFrame:
    """A p-value for each row of a result table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = [f(*x) for x in zip(*(b[c] for c in of))]
            yield b

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {name} double"
    return df.mapInPandas(run, schema)


def chi2_survival(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x) by its finite sums for even and odd k."""
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return total


def with_chi2_p(df: DataFrame, statistic: str, dof: str) -> DataFrame:
    return _map_result(df, [statistic, dof], chi2_survival)


def with_normal_p(df: DataFrame, z: str) -> DataFrame:
    return _map_result(df, [z], lambda v: math.erfc(abs(v) / math.sqrt(2)))


#: Sizes up to which p-values come from counts of orders: of the smaller group and of the counts of U for
#: the rank sums, of the larger group for the distribution functions.
RANK_EXACT, RANK_COUNTS, PATH_EXACT = 8, 1 << 22, 10_000


def rank_sum_counts(a: int, b: int) -> list[int]:
    """Number of orders of a and b rows that give each U from 0 to a * b: the ways to write U as a sum of
    at most a parts of at most b, built up by one row of the smaller group at a time."""
    a, b = min(a, b), max(a, b)
    counts = [1] + [0] * (a * b)
    for i in range(1, a + 1):
        for u in range(a * b, b + i - 1, -1):  # times 1 - q ** (b + i)
            counts[u] -= counts[u - b - i]
        for u in range(i, a * b + 1):  # over 1 - q ** i
            counts[u] += counts[u - i]
    return counts


def rank_sum_p(u: float, a: int, b: int, z: float | None, tied: bool) -> float | None:
    """Two-sided p of U: by counting orders where a group has RANK_EXACT rows at most and no values
    tie, by the normal tail otherwise; null without any spread."""
    if not tied and min(a, b) <= RANK_EXACT and a * b <= RANK_COUNTS:
        counts = rank_sum_counts(a, b)
        return min(1.0, 2 * (sum(counts[round(max(u, a * b - u)) :]) / math.comb(a + b, a)))
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def ks_paths_p(d: float, a: int, b: int) -> float:
    """Share of the orders of a and b rows whose distribution functions are d apart somewhere.

    An order is a path over the grid; the share of the paths to a point that have left the band is a
    mean of those of its two predecessors, so no small number is a difference of large ones.
    """
    least = round(d * a * b)
    if least <= 0:
        return 1.0
    i = np.arange(a + 1)
    out = np.zeros(a + 1)
    for s in range(1, a + b + 1):
        j = s - i
        new = out * (j / s)
        new[1:] += out[:-1] * (i[1:] / s)
        new[np.abs(i * b - j * a) >= least] = 1.0
        new[(j < 0) | (j > b)] = 0.0
        out = new
    return float(min(out[a], 1.0))


def kolmogorov_tail(x: float) -> float:
    """Kolmogorov's limit, P(K > x), by the series that converges faster of two."""
    if x <= 0:
        return 1.0
    if x < 1:
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 12)))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 12)))


def ks_p(d: float, a: int, b: int) -> float:
    """Two-sided p of the largest distance: by counting paths up to PATH_EXACT rows a group, beyond by the
    limit."""
    return ks_paths_p(d, a, b) if max(a, b) <= PATH_EXACT else kolmogorov_tail(d * math.sqrt(a * b / (a + b)))


def with_rank_sum_p(tests: DataFrame) -> DataFrame:
    return _map_result(tests, ["u", "na", "nb", "z", "tied"], rank_sum_p)


def with_ks_p(tests: DataFrame) -> DataFrame:
    return _map_result(tests, ["d", "na", "nb"], ks_p)
