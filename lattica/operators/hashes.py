"""Bit hashes by their distinct values: radius pairs, nearest hashes, and density clusters.

Copies of a hash are the common case, so every search runs on distinct hashes, each with the number of
its rows and their smallest key; rows come back by a join on the hash.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from .relational import checkpointed, spread_lookup

#: Probes of one hash at most.
MAX_PROBES = 2000
#: Distinct hashes of a block where hashes without a near one are compared with all: 16 bytes each.
QUERY_BLOCK, REFERENCE_BLOCK = 1 << 15, 1 << 20
#: Stands for the distance of a null hash, beyond all others.
NO_DISTANCE = 65


def distinct_hashes(rows: DataFrame) -> DataFrame:
    """hash, n, key (the smallest) of the (key, hash) rows, tasks first; null hashes are left out."""
    return rows.where("hash is not null").groupBy(F.col("hash").cast("long").alias("hash")).agg(F.count("*").alias("n"), F.min("key").alias("key"))


def flips(width: int, most: int) -> list[int]:
    """Masks of up to ``most`` of ``width`` bits."""
    return [sum(1 << i for i in x) for n in range(most + 1) for x in itertools.combinations(range(width), n)]


def probes(r: int, bits: int, m: int) -> int:
    """Probes of one hash with m bands: one band differs in r // m bits at most."""
    return m * sum(math.comb(-(-bits // m), i) for i in range(r // m + 1))


def best_bands(r: int, bits: int, n: int) -> int:
    """Number of bands at which one query meets fewest of n random hashes, its probes included."""

    def cost(m: int) -> float:
        return probes(r, bits, m) * (1 + n / 2 ** (bits // m)) if probes(r, bits, m) <= MAX_PROBES else math.inf

    return min(range(1, r + 2), key=cost)


def hash_pairs(left: DataFrame, right: DataFrame, r: int, bits: int = 64, bands: int | None = None) -> DataFrame:
    """Exactly the pairs (hash_a, hash_b, distance) of distinct hashes within r bits.

    With m bands one of them differs in r // m bits at most, so the left side probes each band with
    that many bits flipped.  A pair is kept by the first band that finds it, so that no shuffle is
    needed to tell pairs apart.  More hashes on the right make for fewer and wider bands (None: by
    their number), so that a probe meets few of them.
    """
    m = bands or best_bands(r, bits, right.count())
    cuts = [bits * i // m for i in range(m + 1)]
    widths = [F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long") for a, b in zip(cuts, cuts[1:])]

    def part(hash: Column | str, i: int) -> Column:
        return F.call_function("shiftrightunsigned", hash, F.lit(cuts[i])).bitwiseAND(widths[i])

    def banded(df: DataFrame, name: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(i).alias("band"), part(F.col("hash"), i).alias("part")) for i in range(m)))
        return df.select(F.col("hash").alias(name), F.explode(parts).alias("x")).select(name, "x.*")

    probing = banded(left, "hash_a")
    if r // m:
        masks = [(i, x if x < 1 << 63 else x - (1 << 64)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for x in flips(b - a, r // m)]
        table = left.sparkSession.createDataFrame(masks, "band int, mask long")  # MAX_PROBES rows at most
        probing = probing.join(F.broadcast(table), "band").withColumn("part", F.col("part").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = probing.join(banded(right, "hash_b"), ["band", "part"]).withColumn("distance", hamming("hash_a", "hash_b")).where(F.col("distance") <= r)
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    found = F.array(*(F.bit_count(part(differ, i)) <= r // m for i in range(m)))
    return pairs.where(F.array_position(found, True) - 1 == F.col("band")).select("hash_a", "hash_b", "distance")


def _nearest_in_block(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"hash": left["hash"].slice(0, 0), "ref": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
    right = right.sort_by("ref")  # the first of the nearest has the smallest key
    h, g = (x.to_numpy() for x in (left["hash"], right["ref_hash"]))
    best, at = np.full(len(h), NO_DISTANCE, np.uint8), np.zeros(len(h), np.int64)
    step = max(1, (1 << 22) // len(h))
    for j in range(0, len(g), step):
        d = np.bitwise_count((h[:, None] ^ g[None, j : j + step]).view(np.uint64))
        i, low = d.argmin(axis=1), d.min(axis=1)
        at, best = np.where(low < best, i + j, at), np.minimum(low, best)
    return pa.table({"hash": left["hash"], "ref": right["ref"].take(pa.array(at)), "distance": pa.array(best.astype(np.int32))})


def _by_blocks(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Nearest references of hashes that have none close by, in pairs of blocks.  A block holds a
    million hashes, so that a row is copied once for so many of the other side."""
    nq, nr = (1 + queries.count() // QUERY_BLOCK, 1 + refs.count() // REFERENCE_BLOCK)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n_own).cast("long")))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    q = dealt(queries.select("hash"), "bq", nq, "br", nr)
    r = dealt(refs.select(F.col("hash").alias("ref_hash"), F.col("key").cast("long").alias("ref")), "cr", nr, "cq", nq)
    found = q.groupBy("bq", "br").cogroup(r.groupBy("cq", "cr")).applyInArrow(_nearest_in_block, "hash long, ref long, distance int")
    return found.groupBy("hash").agg(F.min(F.struct("distance", "ref")).alias("m")).select("hash", "m.ref", "m.distance")


def nearest_hashes(queries: DataFrame, refs: DataFrame, bits: int = 64) -> DataFrame:
    """hash, ref (smallest key of the nearest references) and distance of distinct hashes.

    The radius grows while a hash has no reference within it: equal hashes first, then as far as a
    band's flips stay below MAX_PROBES.  Each radius is exact, so a hash that has found something is
    done.  Hashes that are far from all references, where probing would cost more than comparing,
    are compared in blocks.
    """
    refs = checkpointed(refs)
    keyed = refs.select(F.col("hash").alias("hash_b"), F.col("key").alias("ref"))
    left = checkpointed(queries.select("hash"))
    done = left.join(keyed, left["hash"] == keyed["hash_b"]).select("hash", F.col("ref").cast("long").alias("ref"), F.lit(0).alias("distance"))
    left = checkpointed(left.join(keyed, left["hash"] == keyed["hash_b"], "left_anti"))
    n, open_ = refs.count(), left.count()
    for r in (3, 8, 12, 16):
        m = best_bands(r, bits, n)
        # A probe costs about as much as 50 comparisons within a block.
        if not open_ or probes(r, bits, m) > MAX_PROBES or 50 * probes(r, bits, m) * (1 + n / 2 ** (bits // m)) > n:
            break
        near = hash_pairs(left, refs, r, bits, m).join(keyed, "hash_b").groupBy("hash_a").agg(F.min(F.struct("distance", "ref")).alias("m"))
        near = checkpointed(near.select(F.col("hash_a").alias("hash"), F.col("m.ref").cast("long").alias("ref"), F.col("m.distance").cast("int").alias("distance")))
        done = done.unionByName(near)
        left = checkpointed(left.join(near, "hash", "left_anti"))
        open_ = left.count()
    return done.unionByName(_by_blocks(left, refs)) if open_ else done


def hamming_nearest(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Nearest reference hash of every query, the smallest key on ties; (key, hash) rows of longs.

    A null query is at no distance (null) from the reference with the smallest key, and so is every
    query where all references are null; without references there is no row.
    """
    found = nearest_hashes(distinct_hashes(queries), distinct_hashes(references))
    rows = queries.select(F.col("key").cast("long").alias("key"), F.col("hash").cast("long").alias("hash"))
    # A hash that many rows share is looked up in every task.
    out = spread_lookup(rows, found, ["hash"], "left")
    first = references.agg(F.min(F.col("key").cast("long")).alias("first")).where("first is not null")  # one row at most
    return out.crossJoin(F.broadcast(first)).select("key", F.coalesce("ref", "first").alias("ref"), "distance")


def radius_join_hamming(left: DataFrame, right: DataFrame, r: int, bits: int = 64, bands: int | None = None) -> DataFrame:
    """Exactly the pairs of (key, hash) rows within r bits, (a, b, distance).

    Distinct hashes are paired (`hash_pairs`); the rows of each are joined to the pairs afterwards.
    Where copies are many, use the pairs of hashes themselves.  Null hashes are near nothing.
    """
    a, b = (df.where("hash is not null").select(F.col("key").alias(k), F.col("hash").cast("long").alias(f"hash_{k}")).distinct() for df, k in ((left, "a"), (right, "b")))
    pairs = hash_pairs(distinct_hashes(left), distinct_hashes(right), r, bits, bands)
    return pairs.join(a, "hash_a").join(b, "hash_b").groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _windows(eps: int, bits: int) -> list[int]:
    """Masks that leave out ``eps`` neighbouring bits each: hashes equal under one are within eps."""
    every = (1 << bits) - 1
    masks = [every & ~(((1 << eps) - 1) << at) for at in range(0, bits, max(eps, 1))]
    return [x if x < 1 << 63 else x - (1 << 64) for x in masks]


def dbscan_hamming(rows: DataFrame, eps: int = 8, min_samples: int = 5, bits: int = 64) -> DataFrame:
    """Density clusters of (key, hash): the smallest core key of the cluster, or -1 for noise.

    A core has ``min_samples`` rows within ``eps`` bits, itself included; a border row joins the
    neighbouring cluster with the smallest id.  The work is done on distinct hashes, weighted by
    their rows: any number of copies is one point.  A point of ``min_samples`` rows is a core, and so
    are all points that agree outside ``eps`` neighbouring bits where their rows are that many:
    such a group needs no pairs, and hangs together by its smallest member.  Only the other points
    are counted by pairs with all.

    Null hashes are noise.  Rows that repeat a key and hash count each; keys with several hashes
    have the answer of each.
    """
    from .cluster import components

    points = checkpointed(distinct_hashes(rows))
    heavy = points.where(F.col("n") >= min_samples).select("hash")
    masks = F.array(*(F.lit(x).cast("long") for x in _windows(eps, bits)))
    placed = points.select("hash", "n", F.posexplode(masks).alias("window", "mask")).select("hash", "n", "window", F.col("hash").bitwiseAND(F.col("mask")).alias("group"))
    groups = placed.groupBy("window", "group").agg(F.sum("n").alias("rows"), F.count("*").alias("points"), F.min("hash").alias("first")).where((F.col("rows") >= min_samples) & (F.col("points") > 1)).drop("rows", "points")
    dense = checkpointed(placed.join(groups, ["window", "group"]).select("first", "hash"))
    sure = checkpointed(heavy.unionByName(dense.select("hash")).distinct())
    open_ = checkpointed(points.join(sure, "hash", "left_anti").select("hash"))
    # Pairs of the other points with all: their counts, their links, and the clusters they border on.
    pairs = checkpointed(hash_pairs(open_, points, eps, bits))
    counted = pairs.join(points.select(F.col("hash").alias("hash_b"), "n"), "hash_b").groupBy("hash_a").agg(F.sum("n").alias("rows"))
    found = counted.where(F.col("rows") >= min_samples).select(F.col("hash_a").alias("hash"))
    core = checkpointed(sure.unionByName(found))
    between = hash_pairs(sure, sure, eps, bits).where("hash_a < hash_b").select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    ends = core.select(F.col("hash").alias("hash_a")), core.select(F.col("hash").alias("hash_b"))
    linked = pairs.join(ends[0], "hash_a", "left_semi").join(ends[1], "hash_b", "left_semi").select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    stars = dense.where("first <> hash").select(F.col("first").alias("a"), F.col("hash").alias("b"))
    joined = components(core.select(F.col("hash").alias("id")), stars.unionByName(between).unionByName(linked))
    named = joined.join(points.select(F.col("hash").alias("id"), "key"), "id")
    names = named.groupBy("component").agg(F.min("key").alias("cluster"))
    cores = checkpointed(named.join(names, "component").select(F.col("id").alias("hash"), "cluster"))
    border = pairs.join(core, pairs["hash_a"] == core["hash"], "left_anti").join(cores.select(F.col("hash").alias("hash_b"), "cluster"), "hash_b")
    labels = cores.unionByName(border.groupBy(F.col("hash_a").alias("hash")).agg(F.min("cluster").alias("cluster")))
    out = spread_lookup(rows.select("key", F.col("hash").cast("long").alias("hash")), labels, ["hash"], "left")
    return out.select("key", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
