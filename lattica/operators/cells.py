"""Vectors in cells around centres: exact radius joins and largest inner products that skip cells.

Centres are a bounded sample of the vectors, so every task can hold them.  Bounds from the triangle
inequality (of distances, or of angles) tell which cells a query has to see; a choice of other centres
changes the cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import checkpointed

#: Rows of a block where each pair of blocks is compared in one task, and numbers in a packed one.
BLOCK, BLOCK_NUMBERS = 4096, 1 << 18
#: Rows that a radius join may send to cells for each row it has; beyond, packed blocks meet where they lie.
COPIES = 4
#: Centres at most, and numbers in all of them.
CENTRES, CENTRE_NUMBERS = 1024, 1 << 20
#: Rows that are compared with all centres, or with a block, at once.
TOGETHER = 256
_SLACK = 1e-9


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def clean(df: DataFrame) -> DataFrame:
    """(key, v) of the rows that take part: with a key, and a vector of finite numbers."""
    v = F.col("v").cast("array<double>")
    ok = F.col("key").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return df.where(ok).select(F.col("key").cast("long").alias("key"), v.alias("v"))


def alike(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The clean rows of both sides whose vectors are as long as the first of the right side, and the
    number of those on the right."""
    left, right = clean(left), clean(right)
    first = right.agg(F.min(F.struct("key", F.size("v").alias("size"))).alias("m")).first()["m"]
    dims = first["size"] if first else -1
    right = right.where(F.size("v") == dims)
    return left.where(F.size("v") == dims), right, right.count()


def choose_centres(rows: DataFrame, n: int) -> np.ndarray:
    """Up to n distinct vectors of rows that have some, those of the smallest hashes."""
    n = max(1, min(n, CENTRES, CENTRE_NUMBERS // max(1, len(rows.select("v").first()["v"]))))
    found = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(2 * n).toArrow()
    return np.unique(matrix(found["v"]), axis=0)[:n]


def _batches(df: DataFrame, columns: list[str], f: Callable[[np.ndarray, pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Rows of f(vectors, batch), a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                yield pa.RecordBatch.from_pydict(f(matrix(part.column("v")), part))

    return df.select(*columns).mapInArrow(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distances, and how far they may be off."""
    a, b = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None]
    return np.sqrt(np.maximum(a + b - 2 * x @ y.T, 0)), 1e-6 * (np.sqrt(a) + np.sqrt(b))


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and its distance worked out by differences."""
    cell = _distances(x, centres)[0].argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def met(left: DataFrame, right: DataFrame, cell: list[str], compare, schema: str, blocks: DataFrame | None = None) -> DataFrame:
    """Rows of compare(left, right) over the rows that share a cell.  Cells of more than BLOCK rows are
    dealt into blocks, and each pair of blocks is one call.  ``blocks``: (cell, nl, nr), where the numbers
    of blocks are known."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias(name))

    if blocks is None:
        blocks = checkpointed(sizes(left, "nl").join(sizes(right, "nr"), cell))
    own = [f"_{c}" for c in cell]

    def dealt(df: DataFrame, mine: str, n_mine: str, other: str, n_other: str) -> DataFrame:
        x = df.join(blocks, cell).withColumn(mine, F.pmod(F.xxhash64("key"), F.col(n_mine)))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))).drop("nl", "nr")

    l, r = dealt(left, "p", "nl", "q", "nr"), dealt(right, "q", "nr", "p", "nl")
    r = r.withColumnsRenamed({**dict(zip(cell, own)), "p": "_p", "q": "_q"})
    return l.groupBy(*cell, "p", "q").cogroup(r.groupBy(*own, "_p", "_q")).applyInArrow(compare, schema)


# --- radius joins ------------------------------------------------------------------------------


class _Rings:
    """Both sides of a radius join by (cell, ring): the right side in the ring, of width r, of its distance
    to its nearest centre; the left side in every cell and ring where the right side may have a row within r.

    A centre much farther than the nearest one (2 r) cannot be the nearest of such a row, and the
    distances of the two to any centre differ by r at most.
    """

    def __init__(self, left: DataFrame, right: DataFrame, n: int, r: float, cells: int | None):
        self.rows, self.width = left, r if r > 0 else 1.0
        centres = choose_centres(right, cells or max(math.isqrt(n) // 4, n // BLOCK))
        shared, width = right.sparkSession.sparkContext.broadcast(centres), self.width
        self.centres = shared

        def place(x: np.ndarray, b: pa.RecordBatch) -> dict:
            cell, d = _near(x, shared.value)
            return {"key": b.column("key"), "v": b.column("v"), "cell": pa.array(cell, pa.int32()), "ring": pa.array(np.floor(d / width).astype(np.int64))}

        self.placed = checkpointed(_batches(right, ["key", "v"], place, "key long, v array<double>, cell int, ring long"))
        spans = self.placed.groupBy("cell").agg(F.min("ring"), F.max("ring")).collect()  # one row a centre
        low, high = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        for cell, a, b in spans:
            low[cell], high[cell] = a, b

        def seen(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
            d, off = _distances(x, shared.value)
            slack = off + 1e-6 * (1 + r)
            first = np.maximum(np.floor((d - r - slack) / width), low[None])
            last = np.minimum(np.floor((d + r + slack) / width), high[None])
            ok = (d - d.min(axis=1)[:, None] <= 2 * r + 2 * slack) & (first <= last)
            row, cell = np.nonzero(ok)
            a, n = first[row, cell].astype(np.int64), (last[row, cell] - first[row, cell] + 1).astype(np.int64)
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            return row, cell, np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(row)), bool(np.isfinite(d).all())

        self.seen = seen

    def routed(self) -> DataFrame:
        seen = self.seen

        def route(x: np.ndarray, b: pa.RecordBatch) -> dict:
            row, cell, ring, _ = seen(x)
            at = pa.array(row)
            return {"key": b.column("key").take(at), "v": b.column("v").take(at), "cell": pa.array(cell, pa.int32()), "ring": pa.array(ring)}

        return _batches(self.rows, ["key", "v"], route, "key long, v array<double>, cell int, ring long")

    def blocks(self) -> tuple[DataFrame, int]:
        """(cell, ring, nl, nr), the numbers of blocks that meet there, and the rows sent to do so; those
        are endless where squares are no longer finite, so that cells tell nothing."""
        seen = self.seen

        def tally(x: np.ndarray, b: pa.RecordBatch) -> dict:
            _, cell, ring, finite = seen(x)
            at, n = np.unique(np.stack((cell, ring)), axis=1, return_counts=True)
            if not finite:
                at, n = np.append(at, [[-1], [0]], axis=1), np.append(n, 1)
            return {"cell": pa.array(at[0], pa.int32()), "ring": pa.array(at[1], pa.int64()), "l": pa.array(n, pa.int64())}

        left = _batches(self.rows, ["key", "v"], tally, "cell int, ring long, l long").groupBy("cell", "ring").agg(F.sum("l").alias("l"))
        right = self.placed.groupBy("cell", "ring").agg(F.count("*").alias("r"))
        nl, nr = (F.ceil(F.col(c) / BLOCK) for c in "lr")
        both = checkpointed(left.join(right, ["cell", "ring"], "left").select("cell", "ring", nl.alias("nl"), nr.alias("nr"), (F.col("l") * nr + F.col("r") * nl).alias("sent")))
        sent, endless = both.agg(F.sum("sent"), F.count_if(F.col("cell") < 0)).first()
        return both.where("nr is not null").drop("sent"), float("inf") if endless else sent or 0


def ringed(left: DataFrame, right: DataFrame, r: float, cells: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Both sides by (cell, ring), as `_Rings` tells, unless the right one is empty."""
    left, right, n = alike(left, right)
    if not n:
        return None
    rings = _Rings(left, right, n, r, cells)
    return rings.routed(), rings.placed


def _close(x: np.ndarray, y: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exactly the pairs of rows within r, (row of x, row of y, distance), some at a time.

    One matrix product gives half the negative squares of the distances, nearly; what may be near enough, or
    is not finite, is worked out by differences.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (x * x).sum(axis=1) / 2, (y * y).sum(axis=1) / 2
        turned = np.concatenate((y, np.ones((len(y), 1)), -b[:, None]), axis=1).T
        for i in range(0, len(x), TOGETHER):
            part = x[i : i + TOGETHER]
            s = np.concatenate((part, -a[i : i + TOGETHER, None], np.ones((len(part), 1))), axis=1) @ turned
            slack = 1e-9 * (r * r + a[i : i + TOGETHER].max() + b.max())
            at, of = np.nonzero(~(s < -r * r / 2 - slack))
            for j in range(0, len(at), 65536):
                p, q = at[j : j + 65536], of[j : j + 65536]
                exact = np.sqrt(((part[p] - y[q]) ** 2).sum(axis=1))
                ok = exact <= r
                yield p[ok] + i, q[ok], exact[ok]


def _within(r: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            ids, others = (t.column("key").to_numpy() for t in (left, right))
            for at, of, exact in _close(matrix(left["v"]), matrix(right["v"]), r):
                a.append(ids[at])
                b.append(others[of])
                d.append(exact)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "distance": np.concatenate(d)})

    return run


def _block_rows(dims: int) -> int:
    return max(1, min(BLOCK, BLOCK_NUMBERS // max(1, dims)))


def _cut(df: DataFrame, size: int, f: Callable[[np.ndarray, pa.Table], dict], schema: str) -> DataFrame:
    """The rows of each partition in blocks, written once: (keys, vectors, block), and f(vectors, rows)."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        x = matrix(t["v"])
        return pa.RecordBatch.from_pydict({"keys": [t["key"].to_numpy().tobytes()], "vectors": [x.tobytes()], **f(x, t)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, size - rows))
                b, rows = b.slice(size - rows), rows + held[-1].num_rows
                if rows == size:
                    yield block(held)
                    held, rows = [], 0
        if held:
            yield block(held)

    return checkpointed(df.mapInArrow(pack, f"keys binary, vectors binary, {schema}").withColumn("block", F.monotonically_increasing_id()))


def _unpacked(batch: pa.RecordBatch, i: int, keys: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column(keys)[i].as_buffer(), np.int64)
    return ids, np.frombuffer(batch.column(vectors)[i].as_buffer(), float).reshape(len(ids), -1)


def _packed(df: DataFrame, n: int, r: float, centres) -> DataFrame:
    """The n rows in blocks, written once: (keys, vectors, low, high, block), where low and high are the bounds
    of the distances to the origin and to each centre.  Neighbours in a block have about the same norm, cell
    and distance to its centre."""
    width = r / 2 if r > 0 else 1.0
    dims = centres.value.shape[1]
    size = _block_rows(dims)
    order = ["norm", "cell", "ring"]

    def place(x: np.ndarray, b: pa.RecordBatch) -> dict:
        cell, d = _near(x, centres.value)
        norm = np.sqrt((x * x).sum(axis=1))
        return {"key": b.column("key"), "v": b.column("v"), "norm": pa.array(np.floor(norm / width)), "cell": pa.array(cell, pa.int32()), "ring": pa.array(np.floor(d / width))}

    def bounds(x: np.ndarray, t: pa.Table) -> dict:
        pivots = np.concatenate((np.zeros((1, dims)), centres.value))
        low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for at in range(0, len(x), TOGETHER):
            d, off = _distances(x[at : at + TOGETHER], pivots)
            low, high = np.minimum(low, (d - off).min(axis=0)), np.maximum(high, (d + off).max(axis=0))
        low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
        return {"low": [low], "high": [high]}

    placed = _batches(df, ["key", "v"], place, "key long, v array<double>, norm double, cell int, ring double")
    ranged = placed.repartitionByRange(math.ceil(n / (2 * size)) or 1, *order, F.xxhash64("key")).sortWithinPartitions(*order)
    return _cut(ranged.select("key", "v"), size, bounds, "low array<double>, high array<double>")


def _side_by_side(left: DataFrame, right: DataFrame, r: float, once: bool) -> DataFrame:
    """(a, b, distance) of packed blocks, which are read where they lie: a Cartesian product without a shuffle,
    of which only pairs of blocks reach Python whose bounds allow a pair within r.  ``once``: the
    sides are the same, and a < b."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))
    apart = F.greatest(*(F.array_max(F.zip_with(x, y, lambda lo, hi: lo - hi)) for x, y in (("low", "_high"), ("_low", "high"))))
    meet = apart <= r + 1e-6 * (1 + r)
    if once:  # each pair of blocks in one of its orders, as many in one as in the other
        even = (F.col("block") + F.col("_block")) % 2 == 0
        meet = ((F.col("block") == F.col("_block")) | ((F.col("block") < F.col("_block")) == even)) & meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, x), (others, y) = _unpacked(batch, i, "keys", "vectors"), _unpacked(batch, i, "_keys", "_vectors")
                same = batch.column("same")[i].as_py()
                for at, of, d in _close(x, y, r):
                    a, b = ids[at], others[of]
                    if once:
                        ok = a < b if same else a != b
                        a, b, d = np.minimum(a, b)[ok], np.maximum(a, b)[ok], d[ok]
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b, "distance": d})

    pairs = left.hint("shuffle_replicate_nl").join(other, meet)
    return pairs.select("keys", "vectors", "_keys", "_vectors", (F.col("block") == F.col("_block")).alias("same")).mapInArrow(run, "a long, b long, distance double")


def _radius_join(left: DataFrame, right: DataFrame, r: float, cells: int | None, once: bool) -> DataFrame:
    schema = "a long, b long, distance double"
    same = left is right
    left, right, n = alike(left, right)
    if not n:
        return left.sparkSession.createDataFrame([], schema)
    rings = _Rings(left, right, n, r, cells)
    blocks, sent = rings.blocks()
    n_left = n if same else left.count()
    if sent <= COPIES * (n_left + n):
        found = met(rings.routed(), rings.placed, ["cell", "ring"], _within(r), schema, blocks)
        return found.where("a < b") if once else found
    packed = _packed(rings.placed, n, r, rings.centres)
    return _side_by_side(packed if same else _packed(left, n_left, r, rings.centres), packed, r, once)


def radius_join_euclid(left: DataFrame, right: DataFrame, r: float, cells: int | None = None) -> DataFrame:
    """Exactly the pairs of (key, v) rows within Euclidean distance r, (a, b, distance).

    Rows go to the cells and rings where they may find a pair, while those are few; where vectors have no
    groups, each side is written once in blocks, which meet without a shuffle.  Only pairs within r
    leave the tasks that compare them.  Rows without a key, and vectors that are null, hold null, NaN
    or infinity, or are of another length than that of the right side's smallest key, take no
    part; without rows on a side there is no pair.
    """
    return _radius_join(left, right, r, cells, False)


def radius_pairs_euclid(rows: DataFrame, r: float, cells: int | None = None) -> DataFrame:
    """`radius_join_euclid` of rows with themselves, each pair once: a < b."""
    return _radius_join(rows, rows, r, cells, True)


# --- largest inner products --------------------------------------------------------------------


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int = 9, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products of each row of q: (row, index into x, score), the best first and ties
    (to ``digits`` digits) by id.  ``least``: scores below it, for each row of q, may be left out.

    A matrix product finds the rows that may be among them; their scores are summed anew, one pair
    like the other, so that equal vectors have equal scores in blocks of any shape.
    """
    out = []
    step = max(1, min(TOGETHER, (1 << 21) // max(1, len(x))))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        s = part @ x.T
        kth = np.full(len(s), -np.inf) if least is None else least[at : at + step]
        if s.shape[1] > k and np.count_nonzero(s >= kth[:, None]) > 4 * k * len(s):
            kth = np.maximum(kth, np.partition(s, -k, axis=1)[:, -k])
        tie = 2 * 10.0**-digits
        row, col = np.nonzero(s >= (kth - tie - 1e-12 * np.abs(s).max(axis=1))[:, None])
        score = np.concatenate([np.empty(0), *((part[row[i : i + 65536]] * x[col[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536))])
        o = np.lexsort((ids[col], -np.round(score, digits), row))
        row, col, score = row[o], col[o], score[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((row[keep] + at, col[keep], score[keep]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none, np.empty(0)), *out))


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "ref": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = right["key"].to_numpy()
        row, col, score = best_of(matrix(left["v"]), matrix(right["v"]), ids, k)
        return pa.table({"key": left["key"].to_numpy()[row], "ref": ids[col], "score": score})

    return run


def _angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every centre; a zero vector is at a right angle to all."""
    n, m = np.sqrt((x * x).sum(axis=1)), np.sqrt((centres * centres).sum(axis=1))
    scale = n[:, None] * m[None]
    cos = np.divide(x @ centres.T, scale, out=np.zeros(scale.shape), where=scale > 0)
    return n, np.arccos(np.clip(cos, -1, 1))


def _bounds(q: np.ndarray, centres: np.ndarray, wide: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with a vector of each cell: the angle between the two is at
    least the query's to the centre less the cell's width, and norms lie between low and high."""
    n, angle = _angles(q, centres)
    cos = np.cos(np.maximum(angle - wide[None] - 1e-7, 0))
    return n[:, None] * np.where(cos >= 0, high[None], low[None]) * cos + _SLACK * (1 + n[:, None] * high[None])


def _best_of_all(queries: DataFrame, n_queries: int, refs: DataFrame, n: int, dims: int, k: int) -> DataFrame:
    """(key, ref, score) of packed (key, v, kth) queries against all packed (key, v, cell, angle) references,
    read where they lie: those that may be among a query's k largest and not below its kth.  A task holds
    the best of one block of queries, so that what leaves it is k rows a query."""
    size = _block_rows(dims)

    def bounds(x: np.ndarray, t: pa.Table) -> dict:
        norm = np.sqrt((x * x).sum(axis=1))
        centre = (x / np.where(norm > 0, norm, 1)[:, None]).mean(axis=0)
        return {"centre": [centre], "wide": [_angles(x, centre[None])[1].max()], "low": [norm.min()], "high": [norm.max()]}

    def kth(x: np.ndarray, t: pa.Table) -> dict:
        return {"kth": [np.nan_to_num(t["kth"].to_numpy(), nan=-np.inf, neginf=-np.inf)]}

    order = ["cell", "angle"]
    ranged = refs.repartitionByRange(math.ceil(n / (2 * size)), *order, F.xxhash64("key")).sortWithinPartitions(*order)
    right = _cut(ranged.select("key", "v"), size, bounds, "centre array<double>, wide double, low double, high double")
    left = _cut(queries.select("key", "v", "kth").repartition(math.ceil(n_queries / (2 * size)) or 1, "key"), size, kth, "kth array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out = None, None

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": ids[out[0]], "ref": out[1], "score": out[2]})

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("block")[i].as_py() != block:
                    if block is not None:
                        yield held()
                    block = batch.column("block")[i].as_py()
                    ids, x = _unpacked(batch, i, "keys", "vectors")
                    least = batch.column("kth")[i].values.to_numpy().copy()
                    out = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                others, y = _unpacked(batch, i, "_keys", "_vectors")
                centre = batch.column("_centre")[i].values.to_numpy()[None]
                wide, low, high = (np.array([batch.column(c)[i].as_py()]) for c in ("_wide", "_low", "_high"))
                open_ = np.flatnonzero(~(_bounds(x, centre, wide, low, high)[:, 0] < least - 1e-8))
                row, col, score = best_of(x[open_], y, others, k, least=least[open_] - 1e-8)
                row, ref, score = (np.concatenate(z) for z in zip(out, (open_[row], others[col], score)))
                o = np.lexsort((ref, -np.round(score, 9), row))
                row, ref, score = row[o], ref[o], score[o]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                least[row[rank == k - 1]] = np.maximum(least[row[rank == k - 1]], score[rank == k - 1])
                out = row[rank < k], ref[rank < k], score[rank < k]
        if block is not None:
            yield held()

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right.drop("block").select(*(F.col(c).alias(f"_{c}") for c in right.columns if c != "block")))
    return pairs.mapInArrow(run, "key long, ref long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("key").orderBy(F.desc(F.round("score", 9)), "ref")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_topk(queries: DataFrame, references: DataFrame, k: int, cells: int | None = None, steps: tuple[int, ...] = (1, 4), looked_at: list | None = None) -> DataFrame:
    """Exact k largest inner products of (key, v) queries with (key, v) references, (key, ref, score,
    rank); ties, to nine digits, by ref.  Keys are unique longs.

    A query sees the cells of the references in the order of their bounds: the first ``steps[0]`` ones,
    then ``steps[1]`` more, then all others, each time without those whose bound its k-th score
    so far beats.  Cells hold about BLOCK rows unless ``cells`` says otherwise, and large ones are
    dealt into blocks; where the last step would send more than COPIES rows a row, blocks of both sides
    are read where they lie.  Rows without a key, and vectors that are null, hold null, NaN or
    infinity, or are of another length than that of the smallest reference, take no part.
    ``looked_at``, a list, is told the number of pairs that were scored.
    """
    q, refs, n = alike(queries, references)
    schema = "key long, ref long, score double"
    spark = refs.sparkSession
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    centres = choose_centres(refs, cells or n // BLOCK)
    shared = spark.sparkContext.broadcast(centres)

    def place(x: np.ndarray, b: pa.RecordBatch) -> dict:
        norm, angle = _angles(x, shared.value)
        cell = angle.argmin(axis=1)
        return {"key": b.column("key"), "v": b.column("v"), "cell": pa.array(cell, pa.int32()), "norm": pa.array(norm), "angle": pa.array(angle.min(axis=1))}

    placed = checkpointed(_batches(refs, ["key", "v"], place, "key long, v array<double>, cell int, norm double, angle double"))
    stats = placed.groupBy("cell").agg(F.max("angle"), F.min("norm"), F.max("norm")).collect()  # one row a centre
    held = np.array(sorted(r[0] for r in stats))
    wide, low, high = (np.array([r[i] for r in sorted(stats)]) for i in (1, 2, 3))
    found = None
    for lo, hi in zip((0, *np.cumsum(steps).tolist()), (*np.cumsum(steps).tolist(), None)):
        if lo >= len(held):
            break

        def seen(x: np.ndarray, b: pa.RecordBatch, lo=lo, hi=hi) -> tuple[np.ndarray, np.ndarray]:
            bound = _bounds(x, shared.value[held], wide, low, high)
            order = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
            kth = b.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            row, at = np.nonzero(np.take_along_axis(bound, order, axis=1) >= kth[:, None] - 1e-8)
            return row, held[order[row, at]]

        def route(x: np.ndarray, b: pa.RecordBatch, seen=seen) -> dict:
            row, cell = seen(x, b)
            rows = pa.array(row)
            return {"key": b.column("key").take(rows), "v": b.column("v").take(rows), "cell": pa.array(cell, pa.int32())}

        def tally(x: np.ndarray, b: pa.RecordBatch, seen=seen) -> dict:
            cell, l = np.unique(seen(x, b)[1], return_counts=True)
            return {"cell": pa.array(cell, pa.int32()), "l": pa.array(l, pa.int64())}

        if found is None:
            open_ = q.withColumn("kth", F.lit(None).cast("double"))
        else:
            kth = found.groupBy("key").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            open_ = q.join(kth, "key", "left")
        if hi is None:
            asked = _batches(open_, ["key", "v", "kth"], tally, "cell int, l long").groupBy("cell").agg(F.sum("l").alias("l"))
            sizes = placed.groupBy("cell").agg(F.count("*").alias("r"))
            blocks = checkpointed(asked.join(sizes, "cell").select("cell", "l", "r", F.ceil(F.col("l") / BLOCK).alias("nl"), F.ceil(F.col("r") / BLOCK).alias("nr")))
            sent, n_queries = blocks.agg(F.sum(F.col("l") * F.col("nr") + F.col("r") * F.col("nl"))).first()[0] or 0, q.count()
            if sent > COPIES * (n + n_queries):
                if looked_at is not None:
                    looked_at.append(n * n_queries)  # at most
                return _top(_best_of_all(open_, n_queries, placed, n, centres.shape[1], k), k)
        routed = _batches(open_, ["key", "v", "kth"], route, "key long, v array<double>, cell int")
        if looked_at is not None:
            sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
            looked_at.append(routed.join(sizes, "cell").agg(F.sum("n")).first()[0] or 0)
        new = met(routed, placed.select("key", "v", "cell"), ["cell"], _search(k), schema, blocks.select("cell", "nl", "nr") if hi is None else None)
        more = new if found is None else found.select("key", "ref", "score").unionByName(new)
        found = _top(more, k)
        if (hi or len(held)) < len(held):
            found = checkpointed(found)
    return found
