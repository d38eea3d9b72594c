"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, column, long_lists, longs, shingle_set
from .components import components

#: One document in so many is read to find the frequent shingles that go last in the global order.
#: The order decides how many candidates arise and never which links are found.
ORDER_SAMPLE = 8
ORDER_MIN_COUNT = 4
ORDER_MAX = 200_000
#: Partners of one document that are stored in one trie.
TRIE_SETS = 256
_PAIRS_AT_ONCE = 2_000_000
#: Rows of a shingle's list that are paired in one task with as many others; longer lists are paired
#: chunk by chunk.  Lists of several chunks are broadcast by name up to the second number.
CHUNK, FEW_LISTS = 16_384, 1_000_000


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n that must hold a common one with any set of that similarity."""
    return n - -(-percent * n // 100) + 1


class GlobalOrder:
    """Frequent shingles last, by their count; all others first; ties by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        o = np.argsort(shingles)
        self.shingles, self.counts = shingles[o], counts[o]

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, float]:
        """The sorted set in global order, and its share of frequent shingles."""
        if not len(s) or not len(self.shingles):
            return s, 0.0
        k = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        f = np.where(self.shingles[k] == s, self.counts[k], 0)
        return s[np.argsort(f, kind="stable")], float(np.mean(f > 0))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([long_lists([shingle_set(t, width) for t in b.column("text").to_pylist()])], names=["s"])

    return run


def frequent_shingles(docs: DataFrame, width: int) -> GlobalOrder:
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(_sets(width), "s array<long>").select(F.explode("s").alias("t")).groupBy("t").count()
    rows = counts.where(F.col("count") >= ORDER_MIN_COUNT).orderBy(F.desc("count"), "t").limit(ORDER_MAX).toArrow()
    t = rows.column("t").to_numpy().astype(np.int64).view(np.uint64)
    return GlobalOrder(t, rows.column("count").to_numpy().astype(np.int64))


def _described(order, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, frequent, prefix = [], [], [], []
            for t in b.column("text").to_pylist():
                s, share = order.value.sort(shingle_set(t, width))
                if len(s) >= 1 << _N:
                    raise ValueError(f"a text of {len(s)} shingles; postings hold sets of less than 2**{_N}")
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                frequent.append(int(share * 15))
                prefix.append(s[: prefix_length(len(s), percent)] if len(s) else s)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(frequent, pa.int64()), long_lists(prefix)], names=["doc_id", "n", "digest", "frequent", "prefix"])

    return run


# A posting packs (length band, 15 - frequent, n, position) into one long: 7, 4, 27 and 25 bits.
_N, _P = 27, 25


def _may_link(n1, p1, n2, p2, percent: int):
    """Whether two sets can link whose first common element is at these positions."""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return np.minimum(n1 - p1, n2 - p2) >= need


def _postings(chunk: int):
    """Rows sorted by (shingle, posting, rep): drops shingles of one document only, names the first
    row of each (shingle, length band), the one with most frequent shingles, its hub, and numbers
    each list's chunks."""
    names = ["t", "v", "rep", "hub", "hub_v", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        last_shingle, hub, length = None, (None, 0, 0), 0

        def close(t, v, r, more: bool):
            nonlocal last_shingle, hub, held, length
            keep = len(t) - 1 if more else len(t)  # the last row waits for its successor
            same = t[1:] == t[:-1]
            before = np.concatenate(([last_shingle is not None and len(t) > 0 and t[0] == last_shingle], same))
            after = np.concatenate((same, [False]))
            band = v >> 56
            first = np.concatenate(([True], ~same | (band[1:] != band[:-1])))
            at = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
            h, hv = r[at], v[at]
            if len(t) and hub[0] == (t[0], band[0]):
                run = at == 0
                h[run], hv[run] = hub[1], hub[2]
            # Places in the lists, of which the first may have begun before.
            start = np.maximum.accumulate(np.where(before, 0, np.arange(len(t))))
            place = np.arange(len(t)) - start + np.where((start == 0) & before[0], length, 0)
            ok = (before | after)[:keep]
            held = np.stack([t[keep:], v[keep:], r[keep:]])
            if keep:
                last_shingle, hub, length = t[keep - 1], ((t[keep - 1], band[keep - 1]), h[keep - 1], hv[keep - 1]), place[keep - 1] + 1
            return pa.record_batch([longs(x[:keep][ok]) for x in (t, v, r, h, hv, place // chunk)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            t, v, r = (np.concatenate((held[i], column(b, c))) for i, c in enumerate(("t", "v", "rep")))
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (r[1:] != r[:-1])))  # repeated rows
            yield close(t[new], v[new], r[new], True)
        if held.shape[1]:
            yield close(*held, False)

    return run


def _expand(key: np.ndarray, n: np.ndarray, rows: np.ndarray, others: np.ndarray, percent: int, ahead: bool):
    """Pairs (x of rows, y of others) in one list whose lengths fit; ahead: y after x in the order only.
    rows and others are sorted by (key, n)."""
    big = np.int64(1) << 28
    k = key[others] * big + n[others]
    hi = np.searchsorted(k, key[rows] * big + n[rows] * 100 // percent, side="right")
    lo = np.searchsorted(k, key[rows] * big + -(-n[rows] * percent // 100), side="left")
    if ahead:
        lo = np.arange(1, len(rows) + 1)
    count = np.maximum(hi - lo, 0)
    total = np.cumsum(count)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS_AT_ONCE, side="right")))
        c = count[i:j]
        if m := int(c.sum()):
            offset = np.arange(m) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(rows[i:j], c), others[np.repeat(lo[i:j], c) + offset]
        i = j


def _cross_pairs(percent: int):
    """Pairs in one shingle's list that may link with it as their first common one, and whose
    documents are not yet known to be connected.  A group is a list, or two chunks of a long one,
    then paired with each other only.  Within the largest component of a group nothing is paired,
    so a group of copies costs its size."""

    def lists(t, v, rep, comp, lo, hi, side):
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        key, start = np.cumsum(new) - 1, np.flatnonzero(new)
        mixed = (np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start))[key]
        if not mixed.any():
            return
        key, v, rep, comp, lo, hi, side = (x[mixed] for x in (key, v, rep, comp, lo, hi, side))
        n, p = (v >> _P) & ((1 << _N) - 1), v & ((1 << _P) - 1)
        o = np.lexsort((n, key))
        key, n, p, rep, comp, lo, hi, side = (x[o] for x in (key, n, p, rep, comp, lo, hi, side))
        c = np.lexsort((comp, key))
        runs = np.flatnonzero(np.concatenate(([True], (key[c][1:] != key[c][:-1]) | (comp[c][1:] != comp[c][:-1]))))
        size = np.diff(np.concatenate((runs, [len(c)])))
        of = np.empty(len(c), np.int64)
        of[c] = np.repeat(np.arange(len(runs)), size)
        order = np.lexsort((size, key[c][runs]))
        last = np.concatenate((key[c][runs][order][1:] != key[c][runs][order][:-1], [True]))
        main = np.isin(of, order[last])
        whole, one = lo == hi, side == lo
        m, rest = np.flatnonzero(main & whole), np.flatnonzero(~main & whole)
        todo = [(rest, rest, True), (rest, m, False)]
        if not whole.all():
            left, right = (np.flatnonzero(~whole & x) for x in (one, ~one))
            todo += [(left[~main[left]], right, False), (left[main[left]], right[~main[right]], False)]
        for rows, others, ahead in todo:
            for x, y in _expand(key, n, rows, others, percent, ahead):
                ok = (comp[x] != comp[y]) & _may_link(n[x], p[x], n[y], p[y], percent)
                if ok.any():
                    a, b = np.minimum(rep[x[ok]], rep[y[ok]]), np.maximum(rep[x[ok]], rep[y[ok]])
                    pairs = np.unique(np.stack([a, b]), axis=1)
                    yield pa.record_batch([longs(pairs[0]), longs(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the group that may go on, at most two chunks
        for b in batches:
            if not b.num_rows:
                continue
            rows = [column(b, c) for c in ("t", "v", "rep", "comp", "lo", "hi", "side")]
            own = (rows[0] == rows[0][-1]) & (rows[4] == rows[4][-1]) & (rows[5] == rows[5][-1])
            cut = int(np.argmax(own))  # the last group of a batch may go on
            begun = held and all(held[0][i][0] == rows[i][0] for i in (0, 4, 5))
            if held and not begun:
                yield from lists(*(np.concatenate(x) for x in zip(*held)))
                held = []
            if cut:
                held.append([x[:cut] for x in rows])
                yield from lists(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append([x[cut:] for x in rows])
        if held:
            yield from lists(*(np.concatenate(x) for x in zip(*held)))

    return run


def _in_chunks(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of lists of several chunks once for each pair of chunks that holds theirs (lo, hi)."""
    many = lists.where("chunk > 0").groupBy("t").agg((F.max("chunk") + 1).alias("chunks"))
    if many.limit(FEW_LISTS + 1).count() <= FEW_LISTS:
        many = F.broadcast(many)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)).alias("other")
    rows = rows.join(many, "t", "left").select("t", "v", "rep", "comp", F.col("chunk").alias("side"), others)
    return rows.select("t", "v", "rep", "comp", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side")


def enough_in_prefix(common: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of n1 and n2 with that many common prefix elements can link.

    Of the set whose prefix ends first in the global order, common elements are in both prefixes
    or behind its own: at most ``common`` and what it has behind its prefix.
    """

    def behind(n: Column) -> Column:
        return F.ceil(n * percent / 100) - 1

    fits = (F.lit(100) * n1 >= percent * n2) & (F.lit(100) * n2 >= percent * n1)
    return fits & ((100 + percent) * (common + F.greatest(behind(n1), behind(n2))) >= percent * (n1 + n2))


#: Bits of the filter by which documents without candidates are passed over: 16 an id, 16 MB at most.
FILTER_BITS = 27


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids, bounded in size; where ids outgrow it, it lets more documents pass."""
    bits = 1 << min(FILTER_BITS, max(10, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits).cast("long"))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy().view(np.uint64)
    return out, bits


def _lists(order, wanted, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = column(b, "at").astype(np.uint64)
            hit = (wanted.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            b = b.filter(pa.array(hit == 1))
            sets = [order.value.sort(shingle_set(t, width))[0] for t in b.column("text").to_pylist()]
            digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.record_batch([b.column("doc_id"), digest, long_lists(sets)], names=["id", "digest", "s"])

    return run


def _trie_overlaps(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Which sets link with the probe.

    The sets, sorted as sequences of the global order, are the leaves of a trie in depth-first
    order: a set shares the path to its predecessor down to their common prefix, and with it the
    partial overlap counted there.  A path is left once its overlap plus what can still be common
    (by the lengths that remain) is too small.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    have = np.sort(probe)
    linked = [False] * len(sets)
    path, partial, depth = np.empty(0, np.uint64), np.zeros(1, np.int64), 0
    for i in order:
        s = sets[i]
        need = -(-percent * (len(probe) + len(s)) // (100 + percent))
        m = min(len(path), len(s), depth)
        differ = np.flatnonzero(path[:m] != s[:m])
        at = int(differ[0]) if len(differ) else m
        counted = np.zeros(len(s) + 1, np.int64)
        counted[: at + 1] = partial[: at + 1]
        while at < len(s) and counted[at] + min(len(s) - at, len(probe) - counted[at]) >= need:
            step = s[at : at + 128]
            k = np.minimum(np.searchsorted(have, step), len(have) - 1)
            counted[at + 1 : at + 1 + len(step)] = counted[at] + np.cumsum(have[k] == step)
            at += len(step)
        linked[i] = at == len(s) and int(counted[at]) >= need
        path, partial, depth = s, counted, at
    return linked


def _verify(percent: int):
    """Rows sorted by (a, block, b), the probe of a block first with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, probe, ids, sets = None, None, [], []

        def done():
            ok = _trie_overlaps(probe, sets, percent) if probe is not None and sets else []
            return [x for x, y in zip(ids, ok) if y]

        for batch in batches:
            flat, out = batch.column("s"), ([], [])
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
            for i, (a, block, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b")))):
                if (a, block) != now:
                    got = done()
                    out[0].extend([now[0] if now else 0] * len(got))
                    out[1].extend(got)
                    now, probe, ids, sets = (a, block), None, [], []
                s = values[ends[i] : ends[i + 1]].copy()
                if b is None:
                    probe = s
                else:
                    ids.append(b)
                    sets.append(s)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        got = done()
        yield pa.record_batch([pa.array([now[0] if now else 0] * len(got), pa.int64()), pa.array(got, pa.int64())], names=["a", "b"])

    return run


def verified_links(pairs: DataFrame, docs: DataFrame, order, width: int, percent: int) -> Table:
    """Those of the candidate pairs (a, b) whose whole sets link."""
    pairs_t = Table(pairs)
    ids = pairs_t.df.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    words, bits = id_filter(ids)
    wanted = docs.sparkSession.sparkContext.broadcast(words)
    near = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits).cast("long")).alias("at")).where("doc_id is not null")
    found = near.mapInArrow(_lists(order, wanted, width), "id long, digest binary, s array<long>").join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    sets = Table(found.groupBy("id").agg(F.min_by("s", "digest").alias("s")))
    blocks = pairs_t.df.groupBy("a").agg(F.ceil(F.count("*") / TRIE_SETS).alias("blocks"))
    members = pairs_t.df.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
    probes = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"))
    rows = members.unionByName(probes).withColumn("id", F.coalesce("b", "a")).join(sets.df, "id").select("a", "block", "b", "s")
    links = Table(rows.repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(_verify(percent), "a long, b long"))
    pairs_t.drop()
    sets.drop()
    return links


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their word-shingle sets.

    docs: doc_id long, text string; other columns are ignored.  Words are [^\\x20\\x09-\\x0D]+ of
    the text with A-Z lower-cased; a text of fewer words than ``width`` is one shingle.  Two
    documents link when 100 * common >= percent * union.  Returns doc_id, n_shingles,
    component_id (smallest doc_id reachable by links) for every row.

    1. Sets get a global order (frequent shingles last) and equal sets become one class.
    2. Prefix postings meet by shingle.  Each document is first compared with one hub of a list, the
       one with most frequent shingles, which connects groups of near copies at the cost of their size.
    3. Pairs of a list not yet connected follow, if their lengths and the number of their common
       prefix elements allow a link: every link between different sets is found or joins two
       already connected documents.  Lists longer than ``chunk`` are dealt into pairs of chunks.
    4. Comparison walks tries of whole sets (`_trie_overlaps`); components follow.

    Null or empty text: no shingles, its own component.  Null doc_id: n_shingles is given, the
    component is null and it links with nothing.  Rows that repeat a doc_id are one document, judged
    by that of its texts whose set digest is smallest.  Texts are read whole; one of 2**27 shingles
    or more, which a string hardly holds, ends the job with an error.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    order = spark.sparkContext.broadcast(frequent_shingles(docs, width))
    described = Table(docs.mapInArrow(_described(order, width, percent), "doc_id long, n long, digest binary, frequent long, prefix array<long>"))
    d = described.df
    one = d.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = Table(one.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = d.join(classes.df.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"]).select("doc_id", "n", "frequent", F.posexplode("prefix").alias("pos", "t"))
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("long")
    packed = F.shiftleft(band, 56) + F.shiftleft(15 - F.col("frequent"), 52) + F.shiftleft(F.col("n"), _P) + F.col("pos")
    postings = reps.select("t", packed.alias("v"), F.col("doc_id").alias("rep"))
    lists = Table(postings.repartition("t").sortWithinPartitions("t", "v", "rep").mapInArrow(_postings(chunk), "t long, v long, rep long, hub long, hub_v long, chunk long"))

    def size(v: str):
        return F.shiftright(F.col(v), _P).bitwiseAND(F.lit((1 << _N) - 1).cast("long"))

    stars = lists.df.where("hub <> rep").groupBy("rep", "hub", size("v").alias("n1"), size("hub_v").alias("n2")).agg(F.count("*").alias("common"))
    stars = stars.where(enough_in_prefix(F.col("common"), F.col("n1"), F.col("n2"), percent))
    best = stars.groupBy("rep").agg(F.max(F.struct("common", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("rep").alias("b"))
    star_links = verified_links(best, docs, order, width, percent)
    known = components(star_links.df)

    rows = lists.df.select("t", "v", "chunk", F.col("rep").alias("id")).join(known.df, "id", "left")
    rows = _in_chunks(rows.select("t", "v", "chunk", F.col("id").alias("rep"), F.coalesce("component", "id").alias("comp")), lists.df)
    group = ["t", "lo", "hi"]
    cross = Table(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_cross_pairs(percent), "a long, b long").distinct())
    ids = cross.df.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = classes.df.withColumnRenamed("rep", "doc_id").join(ids, "doc_id", "left_semi")
    prefixes = Table(d.join(own, ["doc_id", "digest"]).select("doc_id", "n", "prefix").dropDuplicates(["doc_id"]))

    def side(name: str, i: int) -> DataFrame:
        return prefixes.df.select(F.col("doc_id").alias(name), F.col("n").alias(f"n{i}"), F.col("prefix").alias(f"p{i}"))

    common = F.size(F.array_intersect("p1", "p2"))
    likely = cross.df.join(side("a", 1), "a").join(side("b", 2), "b").where(enough_in_prefix(common, F.col("n1"), F.col("n2"), percent)).select("a", "b")
    cross_links = verified_links(likely, docs, order, width, percent)
    for t in (lists, cross, prefixes):
        t.drop()
    final = components(star_links.df.unionByName(cross_links.df))
    for t in (known, star_links, cross_links):
        t.drop()

    named = classes.df.join(final.df.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_component"))
    of_doc = one.join(named, "digest").select("doc_id", "class_component")
    full = d.select("doc_id", "n").join(of_doc, "doc_id", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("doc_id")).alias("component_id"))
