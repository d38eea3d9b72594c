"""Codes of vectors by codebooks of their parts, with distances to fixed pivots to prune comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

#: Rows whose parts are compared at once.
TOGETHER = 2048
#: Labels of more than one row in so many are looked up by broadcast; there are no more than that.
HOT = 1000
#: Squared distances stay below 2 to this power, so that sums and comparisons are exact.
BITS = 62
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Codebooks:
    """``entries``: one array (entries x components) of integers for each part."""

    cuts: tuple[int, ...]
    entries: tuple[np.ndarray, ...]

    def parts(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, e in zip(self.cuts, self.cuts[1:], self.entries):
            yield v[:, a:b], e

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v, the components as floor(scale * x), of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where(F.coalesce(finite, F.lit(False)) & (F.size("x") > 0))
    # Components of up to m differ by 2m at most, so a squared distance is at most size * (2m)**2.
    largest = F.array_max(F.transform("x", lambda v: F.abs(v * scale))) + 1
    rows = rows.where(F.size("x") * largest * largest < F.lit(2.0 ** (BITS - 2)))
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _matrix(b: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    lists = b.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(b.num_rows, -1)


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """n entries far from each other: each next one is the farthest from those chosen, the first of
    equal ones."""
    chosen, far = [0], ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1).astype(float))


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, of_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each part (the lower one of equal ones), its squared distance,
    and the number of distances that were worked out.

    By the triangle inequality a part and an entry are at least as far apart as their distances to
    any pivot differ.  Entries are taken in the order of that bound until it exceeds the best
    distance so far; distances themselves are whole numbers.
    """
    lower = np.zeros((len(x), len(entries)))
    for j in range(to_pivots.shape[1]):
        np.maximum(lower, np.abs(to_pivots[:, j, None] - of_entries[None, :, j]), out=lower)
    # The stored distances are rounded to 24 bits: the bound gives way by that.
    slack = 2e-7 * (to_pivots.max(axis=1)[:, None] + of_entries.max(axis=1)[None, :]) + 1e-9
    lower = np.square(np.maximum(lower - slack, 0)) * (1 - 1e-12)
    best, at = np.full(len(x), _NONE), np.zeros(len(x), np.int64)
    active, worked = np.arange(len(x)), 0
    while len(active):
        e = lower.argmin(axis=1)
        rows = np.arange(len(active))
        go = lower[rows, e] <= best[active]
        if not go.all():
            active, e, lower, rows = active[go], e[go], lower[go], np.arange(int(go.sum()))
        if not len(active):
            break
        d = ((x[active] - entries[e]) ** 2).sum(axis=1)
        worked += len(d)
        better = (d < best[active]) | ((d == best[active]) & (e < at[active]))
        best[active[better]], at[active[better]] = d[better], e[better]
        lower[rows, e] = np.inf
    return at, best, worked


def _with_pivots(cuts, pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b, "v", np.int64)
                d = np.concatenate([_distances(v[:, i:j], p) for i, j, p in zip(cuts, cuts[1:], pivots)], axis=1).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                yield pa.record_batch([*(b.column(c) for c in ("vec_id", "label", "v")), lists], names=["vec_id", "label", "v", "d"])

    return run


class _Coder:
    """Nearest entries of the rows of a batch, for all parts."""

    def __init__(self, books: Codebooks, pivots: tuple[np.ndarray, ...]):
        self.books, self.of_entries = books, [_distances(e, p) for e, p in zip(books.entries, pivots)]

    def __call__(self, v: np.ndarray, d: np.ndarray):
        """Of each part: number, vectors, indexes, squared distances."""
        at = 0
        for k, ((x, e), of) in enumerate(zip(self.books.parts(v), self.of_entries)):
            to = d[:, at : at + of.shape[1]]
            at += of.shape[1]
            i, best, _ = nearest_entries(x, to, e, of)
            yield k, x, i, best

    def slices(self, b: pa.RecordBatch):
        for at in range(0, b.num_rows, TOGETHER):
            part = b.slice(at, TOGETHER)
            yield part, self(_matrix(part, "v", np.int64), _matrix(part, "d", np.float64))


def _sums(books: Codebooks, pivots):
    """Rows (part, entry, component, sum) of a task, with the count of rows as component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books, pivots)
        sums, counts = [np.zeros(e.shape, np.int64) for e in books.entries], [np.zeros(len(e), np.int64) for e in books.entries]
        for b in batches:
            for _, coded in coder.slices(b):
                for k, x, i, _ in coded:
                    np.add.at(sums[k], i, x)
                    counts[k] += np.bincount(i, minlength=len(counts[k]))
        for k, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            width = s.shape[1]
            rows = (np.full(len(used) * (width + 1), k), np.repeat(used, width + 1), np.tile(np.arange(-1, width), len(used)), np.concatenate([n[used, None], s[used]], axis=1).ravel())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "component", "total"])

    return run


def _codes(books: Codebooks, pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books, pivots)
        for b in batches:
            for part, coded in coder.slices(b):
                code, error = np.empty((part.num_rows, len(books.entries)), np.uint8), np.zeros(part.num_rows, np.int64)
                for k, _, i, best in coded:
                    code[:, k] = i
                    error += best
                text = code.tobytes().hex()
                n = 2 * code.shape[1]
                codes = pa.array([text[i : i + n] for i in range(0, len(text), n)])
                yield pa.record_batch([part.column("vec_id"), part.column("label"), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def updated(books: Codebooks, totals) -> Codebooks:
    """Entries moved to the floor of their parts' mean; those without parts stay."""
    found = {(k, e, c): int(t) for k, e, c, t in totals}
    moved = [x.copy() for x in books.entries]
    for k, e, c in found:
        if c >= 0:
            moved[k][e, c] = found[k, e, c] // found[k, e, -1]
    return Codebooks(books.cuts, tuple(moved))


def encode_vectors(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, pivots: int = 4) -> DataFrame:
    """Product codes of all vectors.

    vectors: vec_id long, embedding array of numbers, label of any type; other columns are ignored.
    Components are taken as floor(256 * x) and vectors cut into ``parts`` equal consecutive parts.
    The codebook of a part starts as that part of the ``size`` smallest vec_ids (256 at most) and is
    moved ``rounds`` times to the floor of its parts' means.  Returns vec_id, code (two hex digits a
    part), error (squared distances summed over parts), label_error (error summed over equal labels)
    and codebooks_sha256.

    Distances of all parts to ``pivots`` fixed vectors (of the first codebook, far from each other)
    are worked out once and written with the vectors; each round only the entries' distances to the
    pivots are new.  The driver holds the codebooks and receives their sums, (components + parts) *
    ``size`` rows whatever the input; tasks and a shuffle add them up.

    Vectors that are null, empty, or hold null or non-finite components take no part; nor do those
    of another length than that of the smallest vec_id, or so large that a squared distance might
    not fit into a long.  A label_error beyond a long is null.  Null vec_ids come after all others.  Repeated rows count each; equal vec_ids
    are ordered by their vectors.  Null labels are equal.  Where the length is no multiple of
    ``parts``, parts differ by one component.  Without vectors there is no row.
    """
    if not 0 < size <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.simpleString()
    rows = integer_vectors(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.select("vec_id", "v").orderBy(*order).limit(1).collect()
    schema = f"vec_id long, label {kind}, code string, error long"
    if not first:
        return spark.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    dims = len(first[0]["v"])
    rows = rows.where(F.size("v") == dims)
    start = np.array([r["v"] for r in rows.select("vec_id", "v").orderBy(*order).limit(size).collect()], np.int64)
    cuts = tuple(dims * i // parts for i in range(parts + 1))
    books = Codebooks(cuts, tuple(start[:, a:b].copy() for a, b in zip(cuts, cuts[1:])))
    fixed = tuple(choose_pivots(e, pivots) for e in books.entries)
    placed = Table(rows.mapInArrow(_with_pivots(cuts, fixed), f"vec_id long, label {kind}, v array<bigint>, d array<float>"))
    for _ in range(rounds):
        sums = placed.df.select("v", "d").mapInArrow(_sums(books, fixed), "part int, entry int, component int, total long")
        books = updated(books, sums.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    coded = Table(placed.df.mapInArrow(_codes(books, fixed), schema))
    placed.drop()
    return _with_label_errors(coded.df).withColumn("codebooks_sha256", F.lit(books.sha256()))


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: labels of many rows, of which there are few, by broadcast, others by shuffle."""
    totals = Table(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))).df
    rows = totals.agg(F.sum("n")).first()[0] or 0
    named = totals.select(F.col("label").alias("l"), "label_error", (F.col("n") * HOT > rows).alias("often"))
    same = F.col("label").eqNullSafe(F.col("l"))
    hot = F.broadcast(named.where("often"))  # fewer than HOT rows
    mine = coded.join(hot, same)
    others = coded.join(hot, same, "left_anti").join(named.where("not often"), same)
    return mine.unionByName(others).drop("l", "often")
