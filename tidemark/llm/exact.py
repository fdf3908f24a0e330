"""Grace hash deduplication with complete content comparison.

1. Every task folds its own rows into an open-addressing table and writes one row for each distinct content it
   holds, with the ids of its copies: a hot group shrinks to a row per task before anything moves. A full table is
   written out and begun anew.
2. A content that very many tasks hold (found by counting hashes alone) is first dealt by its hash and a share of the tasks,
   and merged there, so it arrives at its last task about as often as the root of the number of tasks that hold it.
3. The partial groups are dealt by content hash. A task spills what it receives to files by further hash bits,
   again and again until a bucket fits its memory budget, and folds each bucket in a table of complete contents. A
   bucket that cannot be split any more (equal hashes) is folded as a stream: only distinct contents stay in memory.
4. The group's verdict goes back to the partial groups by their own key, so a hot group stays spread over as many
   rows as tasks, and the ids are expanded.

Defined cases: null texts count as empty and are equal to each other; ties on the id (repeated rows) keep one
value, and each repeated row is returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, in_bitmap, partitions_for, small_batches, stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class OpenTable:
    """Open addressing with linear probing over content hashes; equal slots are compared in full."""

    def __init__(self, size: int = 1024):
        self.slots = np.full(size, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list = []
        self.bytes = 0

    def find(self, h: int, content) -> int:
        """The entry of this content, new if it has none yet."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (e := int(self.slots[at])) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        e = len(self.contents)
        self.slots[at] = e
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * e > len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


class Grace:
    """Folds (hash, content, part, largest id, count) rows into groups; yields (part, largest id, count, the group's first part,
    hash, content) again, the content with the first part alone."""

    def __init__(self, budget: int, fanout: int = 16):
        self.budget, self.fanout = budget, fanout
        self.dir = None

    def run(self, rows):
        held, size = [], 0
        rows = iter(rows)
        try:
            for r in rows:
                held.append(r)
                size += len(r[1]) + 200
                if size > self.budget:
                    yield from self._spill(self._chain(held, rows), 0)
                    return
            yield from self._fold(held)
        finally:
            if self.dir:
                shutil.rmtree(self.dir, ignore_errors=True)

    @staticmethod
    def _chain(held, rows):
        while held:
            yield held.pop()
        yield from rows

    def _spill(self, rows, depth: int):
        """Deal rows to files by the hash bits of this depth, then take the files one by one."""
        self.dir = self.dir or tempfile.mkdtemp(prefix="grace-")
        paths = [os.path.join(self.dir, f"{depth}-{i}-{os.urandom(4).hex()}") for i in range(self.fanout)]
        files, sizes = [open(p, "wb") for p in paths], [0] * self.fanout
        for r in rows:
            i = ((r[0] & (2**64 - 1)) >> (4 * depth)) % self.fanout
            pickle.dump(r, files[i], 5)
            sizes[i] += len(r[1]) + 200
        for f in files:
            f.close()
        for p, size in zip(paths, sizes):
            if size > self.budget and depth < 12:
                yield from self._spill(self._read(p), depth + 1)
            elif size > self.budget:
                yield from self._stream(p)
            elif size:
                yield from self._fold(list(self._read(p)))
            if os.path.exists(p):
                os.unlink(p)

    @staticmethod
    def _read(path):
        with open(path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return

    def _totals(self, rows):
        t, top, count, first = OpenTable(), [], [], []
        for h, content, part, last, n in rows:
            e = t.find(h, content)
            if e == len(top):
                top.append(last)
                count.append(n)
                first.append(part)
            else:
                top[e] = last if top[e] is None or (last is not None and last > top[e]) else top[e]
                count[e] += n
        return t, top, count, first

    def _again(self, rows, t, top, count, first):
        for h, content, part, _, _ in rows:
            e = t.find(h, content)
            yield part, top[e], count[e], first[e], h, content if part == first[e] else None

    def _fold(self, rows):
        yield from self._again(rows, *self._totals(rows))

    def _stream(self, path):
        yield from self._again(self._read(path), *self._totals(self._read(path)))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20,
          bucket_bytes: int = 96 << 20, hot: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256. The row with the largest id of equal texts stays. hot: partial groups
    beyond which a content is merged in two steps."""
    spark = df.sparkSession
    small_batches(spark, 1000)
    norm = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("t")).withColumn("h", F.xxhash64("t")).select("doc_id", "h", F.col("t").cast("binary").alias("t"))

    def local(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 36, 0

        def flush(t, ids):
            nonlocal k
            for s in range(0, len(ids), 500):
                group, n = ids[s : s + 500], len(ids[s : s + 500])
                tops = [max((x for x in g if x is not None), default=None) for g in group]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(base + k, base + k + n), pa.int64()), pa.array(t.hashes[s : s + n], pa.int64()),
                    pa.array(t.contents[s : s + n], pa.binary()), pa.array(tops, pa.int64()), pa.array(group, pa.list_(pa.int64()))],
                    names=["part", "h", "t", "top", "ids"])
                k += n

        t, ids = OpenTable(), []
        for b in batches:
            for doc, h, x in zip(*(c.to_pylist() for c in b.columns)):
                e = t.find(h, x)
                if e == len(ids):
                    ids.append([doc])
                else:
                    ids[e].append(doc)
                    t.bytes += 40
            if t.bytes > table_bytes:
                yield from flush(t, ids)
                t, ids = OpenTable(), []
        yield from flush(t, ids)

    parts = stage(rows.mapInArrow(local, "part long, h long, t binary, top long, ids array<long>"), "grace")

    def merge(with_content: bool):
        form = {"part": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "first": pa.int64(), "h": pa.int64(), "t": pa.binary()}
        form = form if with_content else dict(list(form.items())[:3])

        def pack(out):
            cols = list(zip(*out)) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, form.values())], names=list(form))

        def run(batches):
            def stream():
                for b in batches:
                    yield from zip(*(c.to_pylist() for c in b.columns))

            out, size = [], 0
            for r in Grace(bucket_bytes).run(stream()):
                out.append(r)
                size += len(r[5] or b"") if with_content else 0
                if len(out) == 5000 or size > 16 << 20:
                    yield pack(out)
                    out, size = [], 0
            yield pack(out)

        return run

    cols = ["h", "t", "part", "top", "n"]
    all_ = parts.select("h", "t", "part", "top", F.size("ids").cast("long").alias("n"))
    counts = stage(parts.groupBy("h").agg(F.count(F.lit(1)).alias("tasks")).where(F.col("tasks") > hot), "grace-hot")
    most = counts.agg(F.max("tasks")).first()[0]
    if most is None:
        verdict = all_.repartition(partitions_for(spark), "h").mapInArrow(merge(False), "part long, keep_id long, group_size long")
    else:
        is_hot = in_bitmap(spark, Bitmap.build(counts, "h", 24))
        marked = all_.withColumn("hot", is_hot("h"))
        share = F.pmod(F.xxhash64("part"), F.lit(max(2, round(most**0.5))))
        warm = stage(marked.where("hot").select(*cols).repartition(partitions_for(spark), "h", share).mapInArrow(merge(True), "part long, keep_id long, group_size long, first long, h long, t binary"), "grace-warm")
        once = warm.where("part = first").select("h", "t", "part", F.col("keep_id").alias("top"), F.col("group_size").alias("n"))
        last = stage(marked.where("not hot").select(*cols).unionByName(once).repartition(partitions_for(spark), "h").mapInArrow(merge(False), "part long, keep_id long, group_size long"), "grace-verdict")
        cold = last.join(warm.select("part").hint("merge"), "part", "left_anti")
        verdict = warm.select("part", F.col("first").alias("f")).join(last.select(F.col("part").alias("f"), "keep_id", "group_size").hint("merge"), "f").drop("f").unionByName(cold)
    out = parts.select("part", "ids", F.sha2("t", 256).alias("text_sha256")).join(verdict, "part").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
