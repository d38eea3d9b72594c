"""Best-fit packing of tokenised documents after a dominance reduction."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, column, longs, prefix_sums, substring_hashes

#: Words whose ids a Python worker remembers, in each of two halves.
REMEMBERED = 300_000
#: Characters of texts that are split into words at once, about.
TOGETHER = 1 << 18
#: Pieces of one length and salt that are ranked in one task, about.
RANKED_TOGETHER = 2048
# Texts of ASCII and Latin-1 letters, which have one lower-case form each and no other normal form,
# and, as bytes of Latin-1, how the tokenizer splits them: runs of letters, single digits, runs of
# other signs, and the endings of contractions; fixed values of its pattern.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SPACE, LETTER, DIGIT, OTHER = range(4)
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_LOWER = np.frombuffer(bytes(x + 32 if 65 <= x <= 90 or 0xC0 <= x <= 0xDE and x != 0xD7 else x for x in range(256)), np.uint8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case Latin-1 bytes that end in white space."""
    kind = _CLASS[b]
    new = np.empty(len(b), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == DIGIT
    # A contraction's ending starts at a run of other signs that is one apostrophe.
    quote = np.flatnonzero((b[:-1] == 39) & new[:-1] & (kind[1:] == LETTER))
    for ending in _ENDINGS if len(quote) else ():
        n = len(ending)
        at = quote[quote + n < len(b)]
        for i in range(1, n):
            at = at[b[at + i] == ord(ending[i])]
        new[at + 1] = False
        new[at + n] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(b))
    word = kind[start] != SPACE
    return start[word], end[word]


class WordTokens:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers, by words that recur.

    Plain texts are split into words as the tokenizer does it, and each distinct word (by a 64-bit
    hash) is encoded once while it is remembered; a word's last token is marked as such in the
    vocabulary, so many words are encoded as one text.  All other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Words known: sorted hashes, and where their ids lie in `ids`.  The older half is looked at
        # where a word is new.
        self.known = self.older = self._nothing()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words, and all their ids."""
        sizes, ids = [], []
        for at in range(0, len(words), 2000):
            group = words[at : at + 2000]
            x = self._ids([" ".join(group)])[0]
            cut = np.flatnonzero(self.ends[x]) + 1
            if len(cut) == len(group):
                sizes.append(np.diff(cut, prepend=0))
                ids.append(x)
            else:
                each = self._ids(group)
                sizes.append(np.array([len(y) for y in each], np.int64))
                ids.extend(each)
        return np.concatenate(sizes), np.concatenate(ids)

    @staticmethod
    def _find(table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], hashes)
        near = np.minimum(at, max(len(table[0]) - 1, 0))
        return at, (table[0][near] == hashes if len(table[0]) else np.zeros(len(hashes), bool))

    def _learn(self, hashes: np.ndarray, word_of) -> None:
        """Adds words that are not known yet: sorted distinct hashes, and word_of(i) of the i-th."""
        known, first, size, ids = self.known
        at, have = self._find(self.known, hashes)
        place, old = self._find(self.older, hashes)
        moved, new = np.flatnonzero(old & ~have), np.flatnonzero(~old & ~have)
        parts_first, parts_size, parts_ids, rows = [], [], [ids], []
        if len(moved):
            f, n = self.older[1][place[moved]], self.older[2][place[moved]]
            parts_first.append(len(ids) + np.cumsum(n) - n)
            parts_size.append(n)
            parts_ids.append(_ranges(self.older[3], f, n))
            rows.append(moved)
        if len(new):
            n, more = self._encode_words([word_of(i) for i in new.tolist()])
            parts_first.append(sum(map(len, parts_ids)) + np.cumsum(n) - n)
            parts_size.append(n)
            parts_ids.append(more)
            rows.append(new)
        if rows:
            rows = np.concatenate(rows)
            o = np.argsort(rows)
            rows = rows[o]
            added = (hashes[rows], np.concatenate(parts_first)[o], np.concatenate(parts_size)[o])
            self.known = (*(np.insert(x, at[rows], y) for x, y in zip((known, first, size), added)), np.concatenate(parts_ids))

    @staticmethod
    def _split(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode of texts that each end in a line feed, at ``ends``, and starts and ends
        of their words."""
        b = _LOWER[joined]
        return b, *words_of(b)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        edges = np.cumsum([len(t) + 1 for t in texts])
        b, start, end = self._split(np.frombuffer(("\n".join(texts) + "\n").encode("latin-1"), np.uint8), edges - 1)
        if not len(start):
            return [b""] * len(texts)
        h, index, inverse = np.unique(substring_hashes(prefix_sums(b), start, end), return_index=True, return_inverse=True)
        if len(self.known[0]) > REMEMBERED:
            self.known, self.older = self._nothing(), self.known
        raw = b.tobytes()
        self._learn(h, lambda i: raw[start[index[i]] : end[index[i]]].decode("latin-1"))
        at, _ = self._find(self.known, h)
        first, size = self.known[1][at][inverse], self.known[2][at][inverse]
        ids = _ranges(self.known[3], first, size).tobytes()
        upto = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, edges)]
        return [ids[4 * i : 4 * j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist())]

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """A long text cut at white space, which no word crosses."""
        at = 0
        while len(text) - at > TOGETHER:
            cut = max(text.rfind(x, at, at + TOGETHER) for x in " \n\t")
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    @staticmethod
    def _nothing():
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and not any(x in t for x in self.special) for t in texts]
        out: dict[int, list[bytes]] = {i: [] for i in range(len(texts))}
        group, held = [], 0

        def done() -> None:
            for (i, _), ids in zip(group, self._encode_plain([t for _, t in group])):
                out[i].append(ids)
            group.clear()

        for i, (t, ok) in enumerate(zip(texts, plain)):
            if not ok:
                out[i].append(self._ids([t])[0].tobytes())
                continue
            for part in self.parts(t):
                group.append((i, part))
                held += len(part)
                if held > TOGETHER:
                    done()
                    held = 0
        if group:
            done()
        for x in out.values():
            yield b"".join(x)


def _ranges(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first : first + size] one after the other."""
    return values[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


_workers: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = WordTokens(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = ([], [], [], [], [])
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), _workers[path].encode(texts)):
                    ids += end
                    for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        for x, v in zip(rows, (doc, i, start // 4, len(cut) // 4, zlib.crc32(cut))):
                            x.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def dominance_reduction(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Martello and Toth's reduction on counts by size: fixes, and takes out of ``counts``, the bins
    whose content dominates every other one for their largest item.

    An item goes alone if nothing fits beside it; with a partner that fills the bin; with the largest
    partner that fits if no two items fit, or if at most two fit and none of those pairs is larger
    than that partner.  Returns (content, number of such bins).
    """
    fixed = []
    for s in range(capacity, 0, -1):
        while counts[s]:
            counts[s] -= 1
            present = np.flatnonzero(counts)
            gap = capacity - s
            fits = present[present <= gap]
            if not len(fits):
                n = int(counts[s]) + 1 if s > gap else 1
                fixed.append(([(s, 1)], n))
                counts[s] -= n - 1
                continue
            j = int(fits[-1])
            least = [int(x) for x in fits[:3] for _ in range(min(3, int(counts[x])))][:3]
            one = len(least) < 2 or least[0] + least[1] > gap
            two = len(least) < 3 or sum(least) > gap
            if not (j == gap or one or (two and _largest_pair(counts, fits, gap) <= j)):
                counts[s] += 1
                break
            # The same choice holds for as many of these items as there are such partners: fewer items
            # leave no more that fit together, and no larger pair.
            n = (int(counts[s]) + 1) // 2 if j == s else min(int(counts[s]) + 1, int(counts[j]))
            fixed.append(([(s, 2)] if j == s else [(s, 1), (j, 1)], n))
            counts[s] += 1
            counts[s] -= n
            counts[j] -= n
    return fixed


def _largest_pair(counts: np.ndarray, fits: np.ndarray, gap: int) -> int:
    best, lo, hi = 0, 0, len(fits) - 1
    while lo <= hi:
        pair = int(fits[lo] + fits[hi])
        if pair <= gap and (lo < hi or counts[fits[lo]] > 1):
            best = max(best, pair)
        if pair <= gap:
            lo += 1
        else:
            hi -= 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on counts by size: bins of equal content are filled together."""
    by_rest: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    used = np.zeros(capacity + 1, bool)

    def put(rest: int, content: list[tuple[int, int]], bins: int) -> None:
        if bins:
            by_rest[rest].append((content, bins))
            used[rest] = True

    def fill(rest: int, content: list[tuple[int, int]], bins: int, s: int, n: int) -> int:
        """Puts up to n items into these bins, each filled before the next; returns what is left."""
        each = rest // s
        full = min(bins, n // each)
        put(rest - each * s, [*content, (s, each)], full)
        n, bins = n - full * each, bins - full
        if bins and n:
            put(rest - n * s, [*content, (s, n)], 1)
            n, bins = 0, bins - 1
        put(rest, content, bins)
        return n

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        for rest in np.flatnonzero(used[s:]) + s if n else ():
            classes, by_rest[rest], used[rest] = by_rest[rest], [], False
            for content, bins in classes:
                if n:
                    n = fill(int(rest), content, bins, s, n)
                else:
                    put(int(rest), content, bins)
            if not n:
                break
        if n:
            each = capacity // s
            fill(capacity, [], -(-n // each), s, n)
    return [x for classes in by_rest.values() for x in classes]


def slots(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the r-th piece of each length goes.

    Returns arrays sorted by key: length * 2**40 + first rank of a range of pieces; the sequence of
    the range's first piece, the following ones going to the sequences after it; their offset.
    """
    left = counts.copy()
    bins = dominance_reduction(left, capacity) + best_fit(left, capacity)
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for content, n in bins:
        offset = 0
        for s, times in content:
            for _ in range(times):
                rows.append(((s << 40) + used[s], sequence, offset))
                used[s] += n
                offset += s
        sequence += n
    key, base, offset = np.array(rows or np.empty((0, 3)), np.int64).T
    o = np.argsort(key)
    return key[o], base[o], offset[o]


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            own = (column(b, "length") << 40) + column(b, "rank")
            i = np.searchsorted(key, own, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, longs(base[i] + own - key[i]), longs(offset[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document's tokens, and ``end_id`` after them, into sequences of ``capacity``.

    docs: doc_id long, text string (null: empty); other columns are ignored.  ``tokenizer`` is a
    tokenizers file that every executor can read, whose tokenizer drops white space.  A document of
    more tokens than ``capacity`` is cut into pieces of ``capacity``, the last of them shorter.
    Returns per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    Only the number of pieces by length reaches the driver: at most ``capacity`` rows, whatever the
    input.  The plan (`slots`) is made on these counts and names, for each length, which ranks of
    pieces share a sequence with which; pieces are ranked by salted parts of a length.

    Repeated rows and null doc_ids are documents like others.  An empty text is one piece of one
    token.  A text of any length is tokenised in its own row, part by part.  Pieces of one length
    are told apart by doc_id, piece and checksum; which of equal ones goes where makes no difference.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = Table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id), schema)).df
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():
        counts[length] = n
    plan = spark.sparkContext.broadcast(slots(counts, capacity))
    # A length of many pieces has many parts; at most ``capacity`` lengths are broadcast.
    salts = spark.createDataFrame([(i, 1 + n // RANKED_TOGETHER) for i, n in enumerate(counts.tolist()) if n], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = by_salt.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(plan), schema + ", sequence_id long, offset long")
