"""Removal of byte strings that a document with a smaller id already holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, column, longs, mix, prefix_sums, substring_hashes, window_hashes

#: Bytes of the key by which suffixes are sampled; a string of `length` bytes holds length - KEY + 1.
KEY = 20
#: A place packs (first window, windows) into one long; texts have at most 2**31 bytes.
_LEN = 8
#: Flags of places: those that pass the sort of suffixes are known to be held before, or to be compared
#: by window; windows are compared in the pass that a bit of their sampled suffix's hash says.
_PART, _SETTLED, _DIRECT = 1 << 60, 1 << 61, 1 << 62
_PART_BIT = np.uint64(1 << 8)
_MARK = -1
#: Runs of one key and second hash whose first holders a task remembers from batch to batch; rows of others
#: are compared by window.
REMEMBERED = 100_000
#: Tuples that a task combines before they are shuffled, and runs of one key among them from which on
#: the key counts as open.  Both decide cost, never results.
TOGETHER, MANY_RUNS = 400_000, 32
#: Passes in which windows are compared, each those of half of the sampled suffixes: they bound the disk in use.
PASSES = 2
_U = np.uint64


def sampled_runs(b: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of ``length`` bytes that sample the same suffix.

    The sampled suffix of a window is the one whose first ``key`` bytes have the smallest hash in
    it; that depends on the window alone, so equal windows sample equal suffixes in every document.
    Returns k (56 bits of the key's hash, then 8 of a second hash of the run's whole bytes), r (64
    bits of their first hash), and the first and last windows.
    """
    c = prefix_sums(b)
    m = window_hashes(c, key)
    width, step, other = length - key + 1, 1, np.empty_like(m)
    while step < width:  # minima of step neighbours, then of at most twice as many
        by = min(step, width - step)
        m, other = np.minimum(m[:-by], m[by:], out=other[: len(m) - by]), m
        step += by
    edge = np.concatenate(([True], m[1:] != m[:-1]))
    start = np.flatnonzero(edge)
    most = (1 << _LEN) - 1
    if np.diff(np.concatenate((start, [len(m)]))).max() > most:  # a very long run is cut
        edge |= (np.arange(len(m)) - np.repeat(start, np.diff(np.concatenate((start, [len(m)]))))) % most == 0
        start = np.flatnonzero(edge)
    last = np.concatenate((start[1:] - 1, [len(m) - 1]))
    second = substring_hashes(prefix_sums(b, 1), start, last + length, 1)
    k = (m[start] & ~_U(0xFF)) | (second & _U(0xFF))
    return k, substring_hashes(c, start, last + length), start, last


def _held_before(order: np.ndarray, same: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose like (equal in all of ``same``) a smaller document here holds, one row of each
    kind, and those of kinds with one row.  ``order`` brings like rows together; the rows themselves
    stay in place, as neighbours in a text compress well."""
    o = np.argsort(order, kind="stable")
    new = np.zeros(len(o), bool)
    new[0] = True
    for x in same:
        new[1:] |= x[o][1:] != x[o][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(o)])))
    settled, single = np.empty(len(o), bool), np.zeros(len(o), bool)
    settled[o] = doc[o] > np.repeat(np.minimum.reduceat(doc[o], start), size)
    single[o[start[size == 1]]] = True
    return settled, o[start], single


def _combined(k: np.ndarray, r: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Tuples of one task, combined before they are shuffled.

    A run that a smaller document of the same task holds is settled.  A key with many runs is open
    whatever other tasks hold: those of its runs that come once here go to the comparison by window
    straight away, and a mark says so to the task that sorts the key.  Both pass the sort under keys
    of their own, so that a frequent string sends a few tuples a task to the one that sorts it.
    """
    settled, first, single = _held_before(mix(k) ^ r, (k, r), doc)
    keys, runs = np.unique(k[first] >> _U(8), return_counts=True)
    opened = keys[runs >= MANY_RUNS]
    at = np.minimum(np.searchsorted(opened, k >> _U(8)), max(len(opened) - 1, 0))
    direct = (opened[at] == k >> _U(8)) & single if len(opened) else np.zeros(len(k), bool)
    place = place | np.where(settled, _SETTLED, 0) | np.where(direct, _DIRECT + np.where(k & _PART_BIT, _PART, 0), 0)
    k = np.where(settled | direct, mix(doc.view(np.uint64) ^ (place.view(np.uint64) << _U(20))), k)
    n, none = len(opened), np.iinfo(np.int64).min
    cols = [(k, opened << _U(8)), (r.view(np.int64), np.full(n, none)), (doc, np.full(n, none)), (variant, np.zeros(n, np.int64)), (place, np.full(n, _MARK))]
    names = ["k", "r", "doc", "variant", "place"]
    return pa.record_batch([longs(np.concatenate(x)) for x in cols], names=names)


def _tuples(length: int, key: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, variant, t in zip(*(batch.column(x).to_pylist() for x in ("doc", "variant", "text"))):
                k, r, lo, hi = sampled_runs(np.frombuffer(t.encode("utf-8"), np.uint8), length, key)
                parts.append((k, r, np.full(len(k), doc, np.int64), np.full(len(k), variant, np.int64), (lo << _LEN) + (hi - lo + 1)))
                held += len(k)
                if held > together:
                    yield _combined(*(np.concatenate(x) for x in zip(*parts)))
                    parts, held = [], 0
        if parts:
            yield _combined(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix tuples sorted by k (one number, which Spark sorts by radix), read once.

    kind 1: a run that a smaller document holds whole.  kind 2: every place of a run in its first
    holder whose key also starts other runs, so that some of its windows may be elsewhere; part, a bit
    of the key, is the pass that compares them.  A batch is ordered by run; of the key that may go on, the first
    holders so far are carried over: of one run while it is the only one (places of one doc_id), else
    a row for each run of the last k.  A holder that gives way to a smaller document later has gone
    to the comparison by window like that document's run, which then finds it.
    """
    names = ("k", "r", "doc", "variant", "place")
    carry, sent, last, is_open = [np.empty(0, np.int64)] * 5, np.empty(0, bool), None, False
    for b in batches:
        if not b.num_rows:
            continue
        rows = [column(b, x).astype(np.int64, copy=False) for x in names]
        passing = rows[4] >= _SETTLED
        out = [(*(x[passing] for x in rows[2:]), np.where(rows[4][passing] >= _DIRECT, 2, 1))]
        rows = [np.concatenate((x, y[~passing])) for x, y in zip(carry, rows)]
        sent = np.concatenate((sent, np.zeros(len(rows[0]) - len(sent), bool)))
        if len(sent):
            o = np.lexsort((rows[1], rows[0]))
            (k, r, doc, variant, place), sent = (x[o] for x in rows), sent[o]
            place = place | np.where(k & int(_PART_BIT), _PART, 0)  # marks stay what they are
            key = k >> 8
            new_k = np.concatenate(([True], key[1:] != key[:-1]))
            new_r = new_k | np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
            start = np.flatnonzero(new_r)
            least = np.minimum.reduceat(doc, start)
            held = doc == least[np.cumsum(new_r) - 1]
            group = np.cumsum(new_k) - 1
            several = np.bincount(group[new_r & ~new_k], minlength=group[-1] + 1) > 0
            several[0] |= is_open and key[0] == last
            real = ~sent & (place != _MARK)
            out += [(doc[x], variant[x], place[x], np.full(int(x.sum()), kind)) for x, kind in ((real & ~held, 1), (real & held & several[group], 2))]
            last, is_open = key[-1], bool(several[-1])
            if is_open:
                of = np.flatnonzero(k[start] == k[-1])[:REMEMBERED]
                kept = start[of]
                carry, sent = [k[kept], r[kept], least[of], variant[kept], place[kept]], np.ones(len(kept), bool)
            else:
                kept = np.flatnonzero(held & (group == group[-1]))
                kept = kept[:1] if place[kept[0]] == _MARK else kept
                carry, sent = [x[kept] for x in (k, r, doc, variant, place)], np.zeros(len(kept), bool)
        doc, variant, place, kind = (np.concatenate(x) for x in zip(*out))
        part = np.where((kind == 2) & (place & _PART > 0), 1, 0)
        yield pa.record_batch([longs(x) for x in (doc, variant, place & (_PART - 1), kind, part)], names=["doc", "variant", "place", "kind", "part"])


def _windows(length: int, together: int):
    """Windows of open runs of one pass: two hashes of their bytes, and their places.

    Of equal windows in one task those of the smallest document stand for all; the others are
    settled (place below 0) and pass the sort under hashes of their own.
    """

    def flush(parts: list) -> pa.RecordBatch:
        w, v, doc, variant, at = (np.concatenate(x) for x in zip(*parts))
        settled, _, _ = _held_before(w, (w, v), doc)
        w = np.where(settled, mix(w ^ doc.view(np.uint64) ^ (at.view(np.uint64) << _U(20))), w)
        cols = [longs(w), pa.array(v.view(np.int32)), longs(doc), pa.array(variant.astype(np.int32)), longs(np.where(settled, ~at, at))]
        return pa.record_batch(cols, names=["w", "v", "doc", "variant", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, variant, t, places in zip(*(batch.column(x).to_pylist() for x in ("doc", "variant", "text", "places"))):
                b = np.frombuffer(t.encode("utf-8"), np.uint8)
                p = np.array(places, np.int64)
                lo, n = p >> _LEN, p & ((1 << _LEN) - 1)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                w = substring_hashes(prefix_sums(b), at, at + length)
                v = substring_hashes(prefix_sums(b, 1), at, at + length, 1)
                parts.append((w, (v >> _U(40)).astype(np.uint32), np.full(len(at), doc, np.int64), np.full(len(at), variant, np.int64), at))
                held += len(at)
                if held > 2 * together:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by w (one number, which Spark sorts by radix): those in a document after the
    first one that holds them.  Of the w that may go on, the first holders so far are carried over."""
    carry = [np.empty(0, np.int64)] * 5
    for b in batches:
        if not b.num_rows:
            continue
        rows = [column(b, x).astype(np.int64, copy=False) for x in ("w", "v", "doc", "variant", "at")]
        settled = rows[4] < 0
        out = [(rows[2][settled], rows[3][settled], ~rows[4][settled])]
        w, v, doc, variant, at = rows = [np.concatenate((x, y[~settled])) for x, y in zip(carry, rows)]
        if len(w):
            same = w[1:] == w[:-1]
            if (same & (v[1:] < v[:-1])).any():
                o = np.lexsort((v, w))
                w, v, doc, variant, at = rows = [x[o] for x in rows]
                same = w[1:] == w[:-1]
            new = np.concatenate(([True], ~same | (v[1:] != v[:-1])))
            start = np.flatnonzero(new)
            ok = doc > np.minimum.reduceat(doc, start)[np.cumsum(new) - 1]
            out.append((doc[ok], variant[ok], at[ok]))
            kept = np.flatnonzero(~ok & (w == w[-1]))
            carry = [x[kept] for x in rows]
        doc, variant, at = (np.concatenate(x) for x in zip(*out))
        yield pa.record_batch([longs(doc), longs(variant), longs((at << _LEN) + 1)], names=["doc", "variant", "place"])


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                b = t.encode("utf-8")
                p = np.sort(np.array(places or [], np.int64))
                start, end, kept, spans = p >> _LEN, (p >> _LEN) + (p & ((1 << _LEN) - 1)) - 1 + length, [], 0
                at = 0
                if len(p):
                    reach = np.maximum.accumulate(end)
                    head = np.concatenate(([True], start[1:] > reach[:-1]))
                    for s, e in zip(start[head].tolist(), reach[np.concatenate((head[1:], [True]))].tolist()):
                        kept.append(b[at:s])
                        at, spans = e, spans + 1
                kept = b"".join([*kept, b[at:]])
                for name, x in zip(rows, (len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    rows[name].append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc"), batch.column("digest"), *(pa.array(v, x) for v, x in zip(rows.values(), types))], names=["doc", "digest", *rows])

    return run


def repeated_spans(docs: DataFrame, length: int = 50, key: int = KEY, with_bytes: bool = False, together: int = TOGETHER) -> DataFrame:
    """Bytes of each document left after removal of what smaller doc_ids hold.

    docs: doc_id long, text string (null: empty); other columns are ignored.  A byte goes if a
    string of ``length`` bytes that covers it also starts in a document with a smaller doc_id,
    judged on the input texts as UTF-8.  Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and with ``with_bytes`` the remaining bytes as kept.

    Suffixes are sampled so that equal windows sample equal suffixes; tuples of the sampled ones are
    sorted externally, and the windows between follow from the sampled suffix they belong to: whole
    runs by one comparison, windows of differing runs one by one.  Runs are compared by 128 bits of
    hashes, windows by 88.  Tasks combine equal strings before each shuffle, ``together`` of them at
    a time.

    Null doc_id: nothing is removed and the row serves no other.  Rows that repeat a doc_id are
    judged each by itself, as their ids are not smaller than one another.  Texts shorter than
    ``length`` bytes stay.  Texts are read whole, up to the 2 GB of a string.  An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    ids = docs.where("doc_id is not null").groupBy("digest", "doc_id").agg(F.lit(1))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    # Different texts of one doc_id get a variant number each.
    reps = first.withColumn("variant", (F.row_number().over(W.partitionBy("doc").orderBy("digest")) - 1).cast("int"))
    texts = docs.join(reps.withColumnRenamed("doc", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    texts = Table(texts.select(F.col("doc_id").alias("doc"), "variant", "digest", "text"))
    long_enough = texts.df.where(F.octet_length("text") >= length)
    tuples = long_enough.mapInArrow(_tuples(length, key, together), "k long, r long, doc long, variant long, place long")
    tuples = tuples.withColumn("variant", F.col("variant").cast("int")).repartition(F.shiftright("k", 8))
    induced = Table(tuples.sortWithinPartitions("k").mapInArrow(_induce, "doc long, variant long, place long, kind long, part long"))

    def per_text(df: DataFrame) -> DataFrame:
        return df.groupBy("doc", F.col("variant").cast("int").alias("variant")).agg(F.collect_list("place").alias("places"))

    places, later = induced.df.where("kind = 1").select("doc", "variant", "place"), []
    for part in range(PASSES):
        open_runs = per_text(induced.df.where((F.col("kind") == 2) & (F.col("part") == part)).select("doc", "variant", "place"))
        windows = long_enough.select("doc", "variant", "text").join(open_runs, ["doc", "variant"]).mapInArrow(_windows(length, together), "w long, v int, doc long, variant int, at long")
        later.append(Table(windows.repartition("w").sortWithinPartitions("w").mapInArrow(_later, "doc long, variant long, place long")))
        places = places.unionByName(later[-1].df)
    places = per_text(places)
    schema = "doc long, digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    judged = texts.df.join(places, ["doc", "variant"], "left").select("doc", "digest", "text", "places").mapInArrow(_removed(length), schema)
    judged = Table(judged if with_bytes else judged.drop("kept"))
    for t in (induced, *later, texts):
        t.drop()

    # Every row with an id is the first holder of its text, judged above, or a later copy, all of which goes.
    rows = docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n"), *(["text"] if with_bytes else []))
    rows = rows.join(judged.df.withColumnRenamed("doc", "doc_id"), ["doc_id", "digest"], "left")
    own = F.col("n_removed").isNotNull()
    none = F.col("doc_id").isNull() | (F.col("n") < length)
    out = [
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(none, 0).when(own, F.col("n_removed")).otherwise(F.col("n")).alias("n_removed"),
        F.when(none, 0).when(own, F.col("n_spans")).otherwise(1).cast("long").alias("n_spans"),
        F.when(none, F.lower(F.hex("digest"))).when(own, F.col("kept_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    ]
    if with_bytes:
        out.append(F.when(none, F.encode("text", "UTF-8")).when(own, F.col("kept")).otherwise(F.lit(b"")).alias("kept"))
    return rows.select(*out)
