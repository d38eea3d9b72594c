"""Shared helpers: written intermediate tables, byte hashing and small Arrow tools."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode without that setting, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_cleaning: dict[str, tuple[int, str]] = {}  # sessions: queries that clean up now, and the setting before them
_lock = threading.Lock()


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are removed when each of them ends; queries of one
    session may do so at the same time."""
    name = str(spark._jsparkSession.sessionUUID())
    with _lock:
        n, before = _cleaning.get(name, (0, spark.conf.get(CLEANUP, "false")))
        _cleaning[name] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _cleaning.pop(name)
            if n > 1:
                _cleaning[name] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


class Table:
    """A written intermediate table; ``drop`` removes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = scratch_dir(self.spark)
        with shuffle_cleanup(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# --- hashing of byte strings -------------------------------------------------------------------
# A polynomial hash modulo 2**64 over random byte values, so that the hash of any substring comes
# from two prefix sums; mixed afterwards, as the low bits of the plain sum are weak.  The second
# lane, of another base and other byte values, is independent of the first.

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(x, -1, 2**64) for x in _BASES)
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    t = z >> _U(30)
    z = t ^ z
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= np.right_shift(z, _U(27), out=t)
    z *= _U(0x94D049BB133111EB)
    z ^= np.right_shift(z, _U(31), out=t)
    return z


BYTE_VALUES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * _U(x)) for x in _BASES)
IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as longer texts come."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        _tables[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(b: np.ndarray, lane: int = 0) -> np.ndarray:
    c = np.zeros(len(b) + 1, np.uint64)
    v = BYTE_VALUES[lane][b]
    v *= powers(_BASES[lane], len(b))
    np.cumsum(v, out=c[1:])
    return c


def substring_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end) of the text with prefix sums c."""
    return mix((c[end] - c[start]) * powers(_INVERSES[lane], len(c))[start] + (end - start).astype(np.uint64))


def window_hashes(c: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """`substring_hashes` of every substring of ``width`` bytes, in order."""
    z = c[width:] - c[:-width]
    z *= powers(_INVERSES[lane], len(c))[: len(z)]
    z += _U(width)
    return mix(z)


_LANES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text whose letters A-Z are lower-cased."""
    b = np.frombuffer((text or "").encode("utf-8").lower(), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([1], IS_SPACE[b].view(np.int8), [1])))
    return substring_hashes(prefix_sums(b), np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = min(width, len(w))
    lanes = [_LANES[i % 5] + _U(2 * (i // 5)) for i in range(m)]
    z = np.full(len(w) - m + 1, m, np.uint64)
    for i, lane in enumerate(lanes):
        z += w[i : len(w) - m + 1 + i] * lane
    return np.unique(mix(z))


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> column of one array a row."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), longs(flat))
