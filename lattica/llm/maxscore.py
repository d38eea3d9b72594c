"""Exact top-k search by inner product with MaxScore."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, longs

#: Numbers of one shard at most (its rows: at least SHARD, or a part in SHARDS of all, while they
#: fit), and of the queries that meet it at once.  A copy of a row thus meets thousands of queries.
SHARD, SHARDS, SHARD_NUMBERS, QUERY_NUMBERS = 4096, 256, 1 << 22, 1 << 19
#: Components from here on, and vectors of more components, are multiplied as whole Python numbers;
#: all others fit into 64 bits.
WIDE, WIDE_LENGTH = 1 << 24, 1 << 15
#: Rows that are scored before the threshold is raised.
STEP = 2048


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as integers; of vectors with very large ones v is null and x has
    the components as they were.  Vectors that are null, hold a null or non-finite component or
    have no vec_id are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    wide = F.exists("x", lambda v: F.abs(v * scale) >= WIDE) | (F.size("x") > WIDE_LENGTH)
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(good).withColumn("wide", wide)
    return rows.select("vec_id", F.when(~F.col("wide"), F.transform("x", lambda v: F.floor(v * scale).cast("long"))).alias("v"), F.when(F.col("wide"), F.col("x")).alias("x"))


class Shard:
    """A shard by component, with the bounds of its values."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.dims = ids, np.ascontiguousarray(v.T), v.shape[1]
        self.top = np.maximum(v.max(axis=0), 0) if len(v) else np.zeros(v.shape[1], v.dtype)
        self.low = np.minimum(v.min(axis=0), 0) if len(v) else np.zeros(v.shape[1], v.dtype)

    def postings(self, d: int, positive: bool) -> np.ndarray:
        """Rows whose component d is above, or below, zero."""
        return np.flatnonzero(self.v[d] > 0 if positive else self.v[d] < 0)

    def _score(self, q: np.ndarray, order: np.ndarray, ahead: np.ndarray, rows: np.ndarray, threshold: float | None):
        """Whole scores of those rows that stay competitive."""
        score = np.zeros(len(rows), q.dtype)
        for i in range(0, self.dims, 8):
            terms = order[i : i + 8]
            score = score + q[terms] @ self.v[terms][:, rows]
            if threshold is not None and i + 8 < self.dims:
                ok = score + ahead[i + 8] >= threshold
                if not ok.all():
                    rows, score = rows[ok], score[ok]
        return rows, score

    def search(self, own: int, q: np.ndarray, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, smaller id first) other than the query's own id; with ``least``, a k-th
        score already known elsewhere, those below it may be left out.

        A term's bound is the largest product that the shard's values allow; products below zero
        count zero in it.  Terms go by falling bound; those at the end whose bounds sum to less
        than the k-th score known are non-essential: a row found in none of the essential postings
        cannot get in.  Rows are probed term by term while score so far plus the bounds ahead is
        not below the threshold, which rises as better rows come.
        """
        bound = np.where(q > 0, q * self.top, q * self.low)
        order = np.argsort(-bound, kind="stable")
        ahead = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))  # bounds of the terms from here on
        # A first threshold: whole scores of the best rows by the largest term.
        n, threshold = len(self.ids), least
        seed = np.arange(n) if n <= 4 * k else np.argpartition(-self.v[order[0]] * q[order[0]], 4 * k)[: 4 * k]
        seed = seed[self.ids[seed] != own]
        if len(seed) >= k:
            kth = np.partition(q @ self.v[:, seed], -k)[-k]
            threshold = kth if threshold is None else max(threshold, kth)
        rows = np.arange(n)
        if threshold is not None and threshold > 0:
            essential = int(np.searchsorted(-ahead, -threshold, side="right"))  # ahead[essential] < threshold
            hit = np.zeros(n, bool)
            for d in order[:essential]:
                if bound[d] > 0:
                    hit[self.postings(d, q[d] > 0)] = True
                if hit.all():
                    break
            rows = np.flatnonzero(hit)
        rows = rows[self.ids[rows] != own]
        best, score = rows[:0], np.zeros(0, q.dtype)
        for at in range(0, len(rows), STEP):
            found, s = self._score(q, order, ahead, rows[at : at + STEP], threshold)
            best, score = np.concatenate((best, found)), np.concatenate((score, s))
            if len(best) > k:
                kth = np.partition(score, -k)[-k]
                ok = score >= kth
                best, score = best[ok], score[ok]
                threshold = kth if threshold is None else max(threshold, kth)
        top = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best][top], score[top].astype(np.int64)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of one shard as rows; shorter ones are filled with zeros."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    n = np.diff(ends)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], n)] = flat[ends[0] : ends[-1]]
    return out


def _whole(v: list[int] | None, x: list[float] | None, scale: int) -> list[int]:
    return v if v is not None else [math.floor(c * scale) if math.isfinite(c * scale) else int(c) * scale for c in x]


def _wide_scores(own: int, q: list[int], rows: list[tuple[int, list[int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows, in whole Python numbers; scores beyond a long become its ends."""
    best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != own)[:k]
    info = np.iinfo(np.int64)
    return np.array([i for _, i in best], np.int64), np.array([min(max(-s, info.min), info.max) for s, _ in best], np.int64)


def _search(k: int, scale: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])

        def add(own: int, ids: np.ndarray, scores: np.ndarray) -> None:
            for o, a in zip(out, (np.full(len(ids), own), ids, scores)):
                o.append(a)

        usual, usual_q = (t.filter(pa.compute.is_valid(t.column("v"))) for t in (left, right))
        wide, wide_q = (t.filter(pa.compute.is_null(t.column("v"))) for t in (left, right))
        if usual.num_rows and usual_q.num_rows:
            vs, qs = (t.column("v").combine_chunks() for t in (usual, usual_q))
            width = max(1, *(int(np.diff(x.offsets.to_numpy()).max(initial=1)) for x in (vs, qs)))
            v, q = _matrix(vs, width), _matrix(qs, width)
            if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < 2**53:
                v, q = v.astype(float), q.astype(float)  # sums are exact, and faster
            shard = Shard(usual.column("vec_id").to_numpy(), v)
            for own, x, least in zip(usual_q.column("vec_id").to_pylist(), q, usual_q.column("least").to_pylist()):
                add(own, *shard.search(own, x, k, least))

        def whole(t: pa.Table) -> list[tuple[int, list[int]]]:
            return [(i, _whole(v, x, scale)) for i, v, x in zip(*(t.column(c).to_pylist() for c in ("vec_id", "v", "x")))]

        # Very large numbers on either side.
        wide_rows, every = whole(wide), whole(left) if wide_q.num_rows else []
        for own, q in whole(wide_q):
            add(own, *_wide_scores(own, q, every, k))
        for own, q in whole(usual_q) if wide_rows else []:
            add(own, *_wide_scores(own, q, wide_rows, k))
        return pa.table([longs(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int | None = None) -> DataFrame:
    """The k rows with the largest integer inner product for every query vector.

    vectors: vec_id long, embedding array of numbers; other columns are ignored.  Components become
    floor(scale * x).  Queries: rows whose vec_id is divisible by ``every``; candidates: every row
    with another vec_id.  Ties go to the smaller vec_id.  Returns query_id, rank (from 1), vec_id,
    score.

    Rows are dealt into shards (of ``shard`` rows; None: by their number and length) and queries
    into blocks, both of bounded size.  All queries meet one shard first, which gives each a k-th
    score to begin with; then each block meets each other shard once, `Shard.search` gives the k
    best of a shard, and these merge by query.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no
    part.  Components of any size count in full; a score beyond the range of a long is given as its
    end, and such scores tie.  Missing components of shorter vectors count zero; an empty vector
    scores zero.  Repeated rows are candidates each, in no order of their own; a repeated query
    counts once, with its smallest vector.  An empty table gives an empty result.
    """
    v = Table(quantised(vectors, scale)).df
    n, dims = v.agg(F.count("*"), F.coalesce(F.max(F.greatest(F.coalesce(F.size("v"), F.lit(1)), F.coalesce(F.size("x"), F.lit(1)))), F.lit(1))).first()
    size = shard or max(1, min(SHARD_NUMBERS // max(dims, 1), max(SHARD, n // SHARDS)))
    block = max(1, QUERY_NUMBERS // max(dims, 1))
    asking = v.where(F.col("vec_id") % every == 0).count()
    shards, blocks = 1 + n // size, 1 + asking // block
    queries = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "x")).alias("q")).select("vec_id", "q.v", "q.x")
    queries = Table(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks).cast("long")))).df
    # The written table's rows have fixed numbers, which also spread repeated rows.
    rows = v.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards).cast("long")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(rows: DataFrame, queries: DataFrame) -> DataFrame:
        return rows.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")

    asked = queries.withColumn("shard", F.lit(0).cast("long")).withColumn("least", F.lit(None).cast("long"))
    first = Table(search(rows.where("shard = 0"), asked))
    known = first.df.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = queries.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(shards - 1, 1)).cast("long"))))
    found = first.df.unionByName(search(rows.where("shard > 0"), asked))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
