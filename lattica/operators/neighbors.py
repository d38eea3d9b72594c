"""Nearest centroids, scores of all references, and votes.

Searches of vectors are in `cells`, those of bit hashes in `hashes`, those of names in `names`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hamming, l2_normalise
from .cells import best_of, knn_topk, matrix, radius_join_euclid, radius_pairs_euclid  # noqa: F401
from .hashes import hamming_nearest, radius_join_hamming  # noqa: F401
from .names import fuzzy_match_topk  # noqa: F401
from .relational import checkpointed, numbered

#: Centroids up to this number of rows, and of numbers, are sent to every task as they are.
BROADCAST_ROWS, BROADCAST_NUMBERS = 20_000, 1 << 23


def centroids_by_label(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of every label, scaled to unit length; sums are combined in each task first."""
    long = rows.select(label, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(label, "i").agg(F.avg("x").alias("m"))
    arrays = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return arrays.select(label, l2_normalise("c").alias("centroid"))


def with_each(rows: DataFrame, references: DataFrame, score: Callable[[], Column]) -> DataFrame:
    """Every row with the ``score`` of each reference, where that is the result.  References up to
    BROADCAST_ROWS are broadcast; more are dealt into as many blocks as are broadcast together, and
    the rows are copied to the blocks."""
    n = references.count()
    if n <= BROADCAST_ROWS:
        return rows.crossJoin(F.broadcast(references)).withColumn("score", score())
    blocks = F.lit(1 + n // BROADCAST_ROWS).cast("long")
    refs = references.withColumn("_b", F.pmod(F.xxhash64(*references.columns), blocks))
    every = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return every.join(refs, "_b").withColumn("score", score()).drop("_b")


def top2(queries: DataFrame, centroids: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Best label (the smallest on ties, to nine digits) and inner product of every query, the second one
    (null with one label) and the margin; centroids: one row a label with ``centroid``.

    Up to BROADCAST_ROWS centroids of BROADCAST_NUMBERS numbers go to every task as a matrix, and
    nothing is shuffled; more are searched in cells (`cells.knn_topk`), with the same result: every
    row has a number of its own, labels are numbered in their order, and scores are summed alike.
    A vector that is null, of another length, or not finite has null scores; null labels take no part.  Without
    centroids there is no row.
    """
    return Centroids(centroids, label).top2(queries, key, vector)


class Centroids:
    """Centroids made ready for `top2`, once for any number of query tables."""

    def __init__(self, centroids: DataFrame, label: str):
        c = centroids.where(F.col(label).isNotNull() & F.col("centroid").isNotNull()).select(F.col(label).alias("label"), F.col("centroid").cast("array<double>").alias("c"))
        self.rows, numbers = c.agg(F.count("*"), F.coalesce(F.sum(F.size("c")), F.lit(0))).first()
        self.kind, self.shared, self.numbered = c.schema["label"].dataType, None, None
        if 0 < self.rows <= BROADCAST_ROWS and numbers <= BROADCAST_NUMBERS:
            t = c.orderBy("label").toArrow()
            self.arrow = t.schema.field("label").type
            self.shared = c.sparkSession.sparkContext.broadcast((t["label"].to_pylist(), matrix(t["c"])))
        elif self.rows:
            self.numbered = checkpointed(numbered(c, "ref", "label"))

    def top2(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        rows = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        schema = f"key {rows.schema['key'].dataType.simpleString()}, best_label {self.kind.simpleString()}, best_score double, second_score double"
        if self.shared is not None:
            out = rows.mapInArrow(_two_best(self.shared, self.arrow), schema)
        elif self.numbered is None:
            out = queries.sparkSession.createDataFrame([], schema)
        else:
            asked = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
            found = knn_topk(asked.select(F.col("row").alias("key"), "v"), self.numbered.select(F.col("ref").alias("key"), F.col("c").alias("v")), 2)
            named = found.join(self.numbered.select("ref", "label"), "ref")
            two = named.groupBy(F.col("key").alias("row")).agg(F.min_by("label", "rank").alias("best_label"), F.min_by("score", "rank").alias("best_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"))
            out = asked.join(two, "row", "left").select("key", "best_label", "best_score", "second_score")
        return out.withColumnRenamed("key", key).withColumn("margin", F.col("best_score") - F.col("second_score"))


def _two_best(shared, kind: pa.DataType):
    """labels in rising order, so that the first of equal scores has the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, centroids = shared.value
        ids = np.arange(len(labels))
        for b in batches:
            lists = b.column(1)
            n = b.num_rows
            first, score, second = [None] * n, np.full(n, np.nan), np.full(n, np.nan)
            bad = lists.flatten().to_numpy(zero_copy_only=False)
            ok = np.array([v is not None and len(v) == centroids.shape[1] for v in lists.to_pylist()]) if not np.isfinite(bad).all() or lists.null_count or len(bad) != n * centroids.shape[1] else np.ones(n, bool)
            good = np.flatnonzero(ok)
            x = matrix(lists.take(pa.array(good)))
            finite = np.isfinite(x).all(axis=1)
            good, x = good[finite], x[finite]
            row, col, s = best_of(x, centroids, ids, 2)
            lead = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            score[good[row[lead]]], second[good[row[~lead]]] = s[lead], s[~lead]
            for i, j in zip(good[row[lead]].tolist(), col[lead].tolist()):
                first[i] = labels[j]
            yield pa.record_batch([b.column(0), pa.array(first, kind), *(pa.array(x, pa.float64(), from_pandas=True) for x in (score, second))], names=["key", "best_label", "best_score", "second_score"])

    return run


def assign_open_set(assigned: DataFrame, tau: float, delta: float, reject: int = -1) -> DataFrame:
    ok = (F.col("best_score") >= tau) & (F.coalesce("margin", F.lit(float("inf"))) >= delta)
    return assigned.withColumn("accepted", ok).withColumn("label", F.when(ok, F.col("best_label")).otherwise(reject))


def radius_vote(neighbours: DataFrame, labels: DataFrame, queries: DataFrame, by_distance: bool = False, reject: int = -1) -> DataFrame:
    """Label with most votes among the neighbours of every query, the lowest one on ties; without
    neighbours the query is rejected.  By distance, votes weigh 1/d and exact matches alone count
    where there are some."""
    n = neighbours.join(labels, "b")
    if by_distance:
        exact = F.min("distance").over(W.partitionBy("a")) == 0
        n = n.withColumn("w", F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.greatest(F.col("distance").cast("double"), F.lit(1e-6))))
    else:
        n = n.withColumn("w", F.lit(1.0))
    votes = n.groupBy("a", "label").agg(F.sum("w").alias("votes"))
    best = votes.groupBy("a").agg(F.max(F.struct(F.round("votes", 9).alias("v"), (-F.col("label")).alias("l"))).alias("m"))
    return queries.select(F.col("key").alias("a")).join(best, "a", "left").select(F.col("a").alias("key"), F.coalesce(-F.col("m.l"), F.lit(reject)).alias("label"))


def capped_pairs(pairs: DataFrame, labels: DataFrame, cap: int) -> DataFrame:
    """The pairs (a, b) whose b is among the first ``cap`` sets of its label; labels: set, label."""
    first = labels.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy("set"))).where(F.col("_r") <= cap)
    return pairs.join(first.select(F.col("set").alias("b")), "b", "left_semi")


def mutual_match_ratio(descriptors: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 - mutual nearest pairs / the larger number of descriptors, for pairs (a, b) of sets;
    descriptors: set, id, hash.  Sets without descriptors are at distance 1."""
    sizes = descriptors.groupBy("set").agg(F.count("*").alias("n"))
    x = pairs.join(descriptors.select(F.col("set").alias("a"), F.col("id").alias("i"), F.col("hash").alias("h")), "a")
    x = x.join(descriptors.select(F.col("set").alias("b"), F.col("id").alias("j"), F.col("hash").alias("g")), "b").withColumn("d", hamming("h", "g"))
    from_a = F.row_number().over(W.partitionBy("a", "b", "i").orderBy("d", "j"))
    from_b = F.row_number().over(W.partitionBy("a", "b", "j").orderBy("d", "i"))
    m = x.select("a", "b", from_a.alias("ra"), from_b.alias("rb")).where("ra = 1 and rb = 1").groupBy("a", "b").agg(F.count("*").alias("matches"))
    out = pairs.join(m, ["a", "b"], "left").join(sizes.select(F.col("set").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("set").alias("b"), F.col("n").alias("nb")), "b", "left")
    most = F.greatest("na", "nb")
    return out.select("a", "b", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("na").isNull() | F.col("nb").isNull(), 1.0).otherwise(1 - F.coalesce("matches", F.lit(0)) / most).alias("distance"))
