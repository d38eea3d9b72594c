"""Ranks, prefix counts, medians and seeded splits of groups of any size.

A group may hold a third of all rows, so none is sorted in one task: rows are counted by value, the
counts are range-partitioned, and a partition adds what lies below it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import by_hash, checkpointed, spread_lookup

#: Rows of one hash range, about.
RANGE = 4096


def prefix_sums(rows: DataFrame, group: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """For every group and distinct value: the ``sums``, those of the smaller values (``before_``) and
    of the whole group (``all_``).  Null values are left out; null groups are a group.

    Tasks add up rows first; the distinct values are range-partitioned by (group, value) and summed
    within their partitions.  A group of many values spans many partitions, each of which is one
    row in the window that offsets them.
    """
    group = list(group)
    cells = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*(c.alias(n) for n, c in sums.items()))
    # Written, so that both readers see the same partitions.
    parts = checkpointed(cells.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()))
    below = W.partitionBy("_part", *group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({f"_before_{n}": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in sums})
    totals = parts.groupBy("_part", *group).agg(*(F.sum(n).alias(n) for n in sums))
    order, every = W.partitionBy(*group).orderBy("_part"), W.partitionBy(*group)
    key = {c: f"_g{i}" for i, c in enumerate(group)}
    offsets = totals.select(F.col("_part").alias("_p"), *(F.col(c).alias(k) for c, k in key.items()), *((F.sum(n).over(order) - F.col(n)).alias(f"_offset_{n}") for n in sums), *(F.sum(n).over(every).alias(f"all_{n}") for n in sums))
    same = F.col("_part") == F.col("_p")
    for c, k in key.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = parts.join(offsets, same)
    return out.select(*group, value, *sums, *((F.col(f"_offset_{n}") + F.col(f"_before_{n}")).alias(f"before_{n}") for n in sums), *(f"all_{n}" for n in sums))


def suffix_minima(rows: DataFrame, value: str, of: str) -> DataFrame:
    """Rows of distinct values with ``of`` replaced by its least one among the values not below theirs.

    Running minima within range partitions, from the largest value down, and one row a partition for
    those above; a frame that reached forward would be read anew for every row.
    """
    parts = checkpointed(rows.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    above = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    later = parts.groupBy("_part").agg(F.min(of).alias("_m")).select("_part", F.min("_m").over(above).alias("_later"))
    down = W.partitionBy("_part").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = parts.withColumn(of, F.min(of).over(down)).join(F.broadcast(later), "_part")  # one row a partition
    return out.withColumn(of, F.least(of, "_later")).drop("_part", "_later")


def value_ranks(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean rank, count and number of rows of every distinct value (of a group)."""
    p = prefix_sums(rows, group, value, {"c": F.count("*")})
    return p.select(*group, value, "c", (F.col("before_c") + (F.col("c") + 1) / 2).alias("rank"), F.col("all_c").alias("n"))


def with_pct_rank(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Percentile in the group with the mean rank of ties, rank over number of rows; null values have
    none and are not counted."""
    ranks = value_ranks(rows, value, group)
    cells = ranks.select(*group, value, F.col("c").alias("_n"), (F.col("rank") / F.col("n")).alias(name))
    return spread_lookup(rows, cells, [*group, value], "left", "_n")


def group_medians(rows: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact median of each of ``values`` in every group, as median_<value>: the mean of the two middle
    rows.  Null values are left out; a group without values has null.

    The counts of distinct values name the place of the middle rows, so no task holds a group.
    """
    group = list(group)
    long = rows.select(*group, F.explode(F.array(*(F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values))).alias("_x")).select(*group, "_x.*")
    p = prefix_sums(long, [*group, "_name"], "_v", {"c": F.count("*")})
    low, high = F.floor((F.col("all_c") + 1) / 2), F.floor(F.col("all_c") / 2) + 1
    holds = [(F.col("before_c") < k) & (F.col("before_c") + F.col("c") >= k) for k in (low, high)]
    mid = p.where(holds[0] | holds[1])
    m = mid.groupBy(*group).agg(*((F.max(F.when((F.col("_name") == v) & holds[0], F.col("_v"))) / 2 + F.max(F.when((F.col("_name") == v) & holds[1], F.col("_v"))) / 2).alias(f"median_{v}") for v in values))
    return m


def with_medians(summary: DataFrame, rows: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A table of one row a group, with the medians of its rows."""
    m = group_medians(rows, group, values)
    key = {c: f"_g{i}" for i, c in enumerate(group)}
    m = m.select(*(F.col(c).alias(k) for c, k in key.items()), *(f"median_{v}" for v in values))
    same = F.lit(True)
    for c, k in key.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    return summary.join(m, same, "left").drop(*key.values())


def hash_ranks(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Rows with _h (their seeded hash), _r (place in their label by hash and key), _n (rows of the
    label).

    The first digits of the hash cut a label into ranges of about RANGE rows; counts of the ranges
    place a row's range, and only rows of one range are ordered among each other.
    """
    digits = max(1, math.ceil(math.log(max(df.count(), 1) / RANGE + 1, 16)))
    h = df.withColumn("_h", by_hash(key, seed)).withColumn("_d", F.substr("_h", F.lit(1), F.lit(digits)))
    sizes = h.groupBy(label, "_d").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(label).orderBy("_d")) - F.col("_c")
    places = sizes.select(F.col(label).alias("_l"), F.col("_d").alias("_e"), before.alias("_before"), F.sum("_c").over(W.partitionBy(label)).alias("_n"))
    within = F.row_number().over(W.partitionBy(label, "_d").orderBy("_h", key))
    placed = h.withColumn("_w", within).join(places, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_d") == F.col("_e")))
    return placed.withColumn("_r", F.col("_before") + F.col("_w")).drop("_l", "_e", "_d", "_w", "_before")


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int, folds: int = 5) -> DataFrame:
    """Each class's rows in hash order: the first max(1, round(n * share)), n - 1 at most, are the test."""
    ranked = hash_ranks(df, label, key, seed)
    size = F.least(F.greatest(F.round(F.col("_n") * share), F.lit(1)), F.col("_n") - 1)
    return ranked.select(*df.columns, F.when(F.col("_r") <= size, "test").otherwise("train").alias("split"), (F.col("_r") % folds).cast("int").alias("fold"))


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """About proportional quotas, one at least, then trimmed or topped up to n in hash order."""
    ranked = hash_ranks(df, label, key, seed)
    total = df.agg(F.count("*").alias("_total"))
    quota = F.greatest(F.lit(1), F.round(F.col("_n") * n / F.col("_total")))
    extra = ranked.crossJoin(F.broadcast(total)).withColumn("_extra", F.col("_r") > quota)  # one row
    return extra.orderBy("_extra", F.col("_r") > 1, "_h", key).limit(n).select(*df.columns)
