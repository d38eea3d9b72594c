"""First-fit decreasing packing of tokenised documents, in random groups, with a tournament tree of the
sequences' free room."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import TOGETHER, WordTokens

#: Documents of one group, about, and rows of one partition, about, where there are many.
GROUP, PARTITION = 4096, 65_536
# Bytes of Latin-1 by the classes of the byte-level pattern; fixed values.  Texts hold no others than
# those that `packing` calls plain.
WHITE, LETTER, DIGIT, OTHER, END = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
_CLASS[48:58] = DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_words(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings that a byte-level tokenizer encodes on their own; ``ends`` are the
    places after each text, which belong to none.

    Letters, digits and other signs make up runs, which take a space before them along; the endings
    of contractions stand alone unless a space comes before; of other white space, all but the last
    character before such a run is one string.
    """
    kind = _CLASS[b]
    kind[ends] = END
    new = np.empty(len(b), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[ends] = True
    run = np.flatnonzero(new[1:] & (kind[1:] != END) & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
    new[run - 1] = True
    new[run[b[run - 1] == 32]] = False
    quote = np.flatnonzero((b[:-1] == 39) & (kind[:-1] == OTHER) & new[:-1] & (kind[1:] == LETTER))
    for ending in _ENDINGS if len(quote) else ():
        n = len(ending)
        at = quote[quote + n < len(b)]
        for i in range(1, n):
            at = at[b[at + i] == ord(ending[i])]
        new[at + 1] = False
        new[at + n] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(b))
    word = kind[start] != END
    return start[word], end[word]


class ByteTokens(WordTokens):
    """Ids of a byte-level tokenizer, by strings that recur."""

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x for at in range(0, len(words), 2000) for x in self._ids(words[at : at + 2000])]
        return np.array([len(x) for x in each], np.int64), np.concatenate(each)

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """A long text cut before the last white space of a run, which begins the next string."""
        at = 0
        while len(text) - at > TOGETHER:
            cut = at + TOGETHER
            while cut > at and (not text[cut].isspace() or text[cut + 1 : cut + 2].isspace()):
                cut = max(text.rfind(x, at, cut) for x in " \n\t")
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    @staticmethod
    def _split(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return joined, *byte_words(joined, ends)


class Tournament:
    """Free room of sequences in a tree whose inner nodes hold the larger one of their two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first sequence with room for ``size``."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, i: int, size: int) -> None:
        at = i + self.leaves
        self.room[at] -= size
        while at > 1:
            at //= 2
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each sequence: the longest first, the earlier of equal ones, each in the first
    sequence that has room."""
    tree, bins = Tournament(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        i = tree.first(sizes[item])
        if i == len(bins):
            bins.append([])
        tree.take(i, sizes[item])
        bins[i].append(item)
    return bins


def _whole(n: int) -> bool:
    """A length that needs no padding below the capacity: a power of two."""
    return n & (n - 1) == 0


def without_padding(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The sequences as pieces (item, start, length), after cuts that leave no padding.

    Sequences that are full or as long as a power of two stay.  Of the others the fullest takes
    pieces from the emptiest, the shortest first, cut where one does not fit, until it is full.  The
    one left over is cut into sequences of powers of two.
    """
    done, rest = [], []
    for b in bins:
        used = sum(sizes[i] for i in b)
        full = used == capacity or _whole(used)
        (done if full else rest).append([used, [(i, 0, sizes[i]) for i in b]])
    rest.sort(key=lambda x: -x[0])
    lo, hi = 0, len(rest) - 1
    while lo < hi:
        to, source = rest[lo], rest[hi]
        item, start, length = source[1].pop()
        n = min(length, capacity - to[0])
        to[1].append((item, start, n))
        if n < length:
            source[1].append((item, start + n, length - n))
        to[0] += n
        source[0] -= n
        if to[0] == capacity:
            done.append(to)
            lo += 1
        if not source[0]:
            hi -= 1
        elif lo < hi and _whole(source[0]):
            done.append(source)
            hi -= 1
    out = [x for _, x in done]
    if lo == hi:
        used, left = rest[lo]
        while used:
            room, pieces = 1 << (used.bit_length() - 1), []
            used -= room
            while room:
                item, start, length = left[0]
                n = min(length, room)
                pieces.append((item, start, n))
                left[0:1] = [(item, start + n, length - n)] if n < length else []
                room -= n
            out.append(pieces)
    return out


_workers: dict[str, ByteTokens] = {}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _tokenised(path: str, capacity: int, end_id: int, with_ids: bool):
    """Full pieces with their checksum, and what is left of each document as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = ByteTokens(path)
        tokens = _workers[path]
        small = len(tokens.ends) <= 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = ([], [], [], [], [], [])
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.encode(texts)):
                    ids += end
                    for start in range(0, len(ids), 4 * capacity):
                        cut = ids[start : start + 4 * capacity]
                        kept = cut if with_ids or len(cut) < 4 * capacity else None
                        if kept and small:
                            kept = np.frombuffer(kept, "<u4").astype("<u2").tobytes()
                        for x, v in zip(rows, (doc, start // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4, kept)):
                            x.append(v)
                types = (*[pa.int64()] * 5, pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _wide(ids: bytes | None, n: int) -> bytes | None:
    """Ids as 32-bit numbers, which two bytes each are made into."""
    return ids if ids is None or len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _grouped(capacity: int, group: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    types = [*[pa.int64()] * 7, *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            sizes, rows = [x[2] for x in held], []
            for pieces in without_padding(first_fit_decreasing(sizes, capacity), sizes, capacity):
                offset = 0
                for i, start, n in pieces:
                    doc, first, length, crc, total, ids = held[i]
                    if n < length or with_ids:
                        ids = _wide(ids, length)[4 * start : 4 * (start + n)]
                        crc = zlib.crc32(ids)
                    rows.append((doc, first + start, n, crc, total, sequence, offset, *([ids] if with_ids else [])))
                    offset += n
                sequence += 1
            held.clear()
            return batch(rows)

        for b in batches:
            full = []
            for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))):
                if x[2] < capacity:
                    held.append(x)
                    if len(held) == group:
                        yield packed()
                else:
                    full.append((*x[:5], sequence, 0, *([_wide(x[5], capacity)] if with_ids else [])))
                    sequence += 1
            if full:
                yield batch(full)
        if held:
            yield packed()

    return run


def pack_first_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Packs every document's tokens, and ``end_id`` after them, into sequences of ``capacity``, a power
    of two, without padding.

    docs: doc_id long, text string (null: empty); other columns are ignored.  ``tokenizer`` is a
    file of a byte-level tokenizer that every executor can read.  Returns per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids themselves.

    A document's full pieces of ``capacity`` are sequences of their own.  What is left of each is
    dealt evenly over the partitions and put in an order by hash, whose successive ``group``
    documents are packed by themselves: a task holds one group, of less than ``group * capacity``
    ids.  First-fit decreasing places them uncut; its unfilled sequences, some of the last of a group, fill
    each other by cuts, and one remainder a group becomes sequences of powers of two.

    Repeated rows and null doc_ids are documents like others, an empty text is one piece of one
    token, equal lengths go in the order of the hash, and a text of any length is tokenised in its
    own row.  An empty table gives an empty result.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    n = docs.count()
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PARTITION))
    partitions = min(wide, 1 + n // group)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenised(tokenizer, capacity, end_id, with_ids), f"{PIECE}, ids binary")
    # Round-robin dealing orders rows by hash first, so that a task that is run again deals alike.
    dealt = rows.repartition(partitions).sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32", "length"))
    return dealt.mapInArrow(_grouped(capacity, group, with_ids), f"{PIECE}, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
