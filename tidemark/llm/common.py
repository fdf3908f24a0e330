"""Shared pieces of the training-data operators: staged tables, bounded bitmaps,
and vectorised word hashing over Arrow string buffers.

Words are hashed without a Python loop: a polynomial prefix sum over the bytes of
a batch gives the hash of any byte range as (S[end] - S[start]) * B^-start
(mod 2^64), which is then mixed.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE = 1 << 18  # bytes hashed at a time; bounds the temporary arrays and keeps them in cache


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a private one only where that is unset and driver and executors are
    one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark"


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone at exit
        pass


#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession):
    """Queries run in here give their shuffle files back when they end."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. The shuffle files behind it
    are given back at once: whoever executes df itself again computes them anew."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in staged:
        remove(df.sparkSession, df.staged_at)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python by rows and bytes, whatever the lengths of texts. As plans are executed after
    this returns, the bounds stay in the session, the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:
        pass


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

# The multipliers and shifts of the splitmix64 finaliser, and its increment as the base of the polynomial.


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, SLICE + (1 << 14))
        with np.errstate(over="ignore"):
            _POW[:] = [np.cumprod(np.concatenate(([U64(1)], np.full(m - 1, b, U64)))) for b in (BASE, BASE_INV)]
    return _POW[0], _POW[1]


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NON_WORD = np.ones(256, bool)  # ASCII letters, digits and every byte of a non-ASCII character form words
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word's index of every row (one more at the end)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~separators[buf]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range. The ranges are sorted and disjoint; slices keep temporaries small."""
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        pw, inv = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((buf[lo:hi].astype(U64) + U64(1)) * pw[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U64))
        i = j
    return out


_STEP = mix(np.arange(1, 513, dtype=U64)) | U64(1)


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive words, over all rows alike; mask() tells which lie in one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += words[j : j + n] * _STEP[(salt * 64 + j) % 512] + (words[j : j + n] >> U64(29)) * _STEP[(salt * 64 + j + 37) % 512]
    return mix(out)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


# ---------------------------------------------------------------- bounded bitmaps


class Bitmap:
    """A bit set of fixed size over 64-bit hashes: false positives only. Its size, at most 2^bits / 8 bytes, does
    not depend on the data, so it may be broadcast; beyond its capacity it filters less but loses nothing."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def build(df: DataFrame, column: str, bits: int = 26) -> "Bitmap":
        slot = F.shiftrightunsigned(F.col(column), 64 - bits)
        parts = df.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("b"))
        with released(df.sparkSession):
            got = parts.select("w", "b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), U64)
        if got.num_rows:
            words[got["w"].to_numpy()] = got["b"].to_numpy().view(U64)
        return Bitmap(words, bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> U64(64 - self.bits)
        return (self.words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == U64(1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def table_schema(**types) -> str:
    return ", ".join(f"{k} {v}" for k, v in types.items())


def in_bitmap(spark: SparkSession, bits: Bitmap):
    """A column function: whether a 64-bit hash may be in the bitmap. Only the hash travels to Python."""
    import pandas as pd

    shared = spark.sparkContext.broadcast(bits)
    return F.pandas_udf(lambda h: pd.Series(shared.value.has(h.to_numpy().astype(np.int64).view(U64))), "boolean")


# ---------------------------------------------------------------- repeated keys


class Sieve:
    """Finds keys that differing owners share, without a row for each key.

    Tasks fold (key, owner) pairs to one entry a key with its least and largest owner and whether any pair was marked,
    and send them as packed arrays, one row for each range of keys (`ranges`, which grow with the partitions). Where a
    range meets, keys with two owners or more and a mark set their bits of a bounded Bitmap. Hot keys shrink to an entry
    a task before they move. Owners are compared in full (64 bits)."""

    FORM = "range int, k binary, a binary, z binary, m binary"

    def __init__(self, spark: SparkSession, bits: int = 26):
        self.bits, self.partitions = bits, partitions_for(spark)
        self.ranges = min(16, max(6, int(np.ceil(np.log2(4 * self.partitions)))))

    def pack(self, parts):
        """parts: iterable of (keys u64, owners i64, marks bool) -> record batches."""
        held, size = [], 0
        for p in parts:
            if len(p[0]):
                held.append((p[0], p[1], p[1], p[2]))
                size += len(p[0])
            if size > 1_500_000:
                yield self._rows(*self._fold(held))
                held, size = [], 0
        if held:
            yield self._rows(*self._fold(held))

    @staticmethod
    def _fold(held):
        k, a, z, m = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(k)
        k = k[order]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[cut], np.minimum.reduceat(a[order], cut), np.maximum.reduceat(z[order], cut), np.maximum.reduceat(m[order].astype(np.uint8), cut)

    def _rows(self, k, a, z, m):
        which = (k >> U64(64 - self.ranges)).astype(np.int32)
        ids = np.unique(which)
        lo, hi = np.searchsorted(which, ids), np.searchsorted(which, ids, "right")
        cols = [[x[i:j].tobytes() for i, j in zip(lo, hi)] for x in (k, a, z - a, m)]
        return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c, pa.binary()) for c in cols]], names=["range", "k", "a", "z", "m"])

    def bitmap(self, packed: DataFrame) -> Bitmap:
        width = self.bits - self.ranges

        def close(which, held):
            k, a, z, m = self._fold(held)
            live = k[(a != z) & (m > 0)]
            slots = np.zeros(1 << width, np.uint8)
            slots[((live >> U64(64 - self.bits)) & U64((1 << width) - 1)).astype(np.int64)] = 1
            return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([zlib.compress(np.packbits(slots, bitorder="little").tobytes(), 1)]), pa.array([len(live)], pa.int64())], names=["range", "bits", "n"])

        def merge(batches):
            now, held, size = None, [], 0
            for b in batches:
                for w, k, a, d, m in zip(*(c.to_pylist() for c in b.columns)):
                    if w != now and held:
                        yield close(now, held)
                        held, size = [], 0
                    now = w
                    a = np.frombuffer(a, np.int64)
                    held.append((np.frombuffer(k, U64), a, a + np.frombuffer(d, np.int64), np.frombuffer(m, np.uint8)))
                    size += len(a)
                    if size > max(4_000_000, 2 * len(held[0][0])):  # of a range, one entry a key is held
                        held = [self._fold(held)]
                        size = len(held[0][0])
            if held:
                yield close(now, held)

        with released(packed.sparkSession):
            got = packed.repartition(self.partitions, "range").sortWithinPartitions("range").mapInArrow(merge, "range int, bits binary, n long").toArrow()
        words = np.zeros(1 << (self.bits - 3), np.uint8)
        for w, data in zip(got["range"].to_pylist(), got["bits"].to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            words[w << (width - 3) : (w + 1) << (width - 3)] = part
        return Bitmap(words.view(U64), self.bits)
