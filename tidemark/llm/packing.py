"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs what it reads, so nothing is shuffled: a bounded pool of pieces waits; the open bin takes the
fitting piece whose demand has the largest dot product with the bin's remaining capacity; when none fits, the
best piece is cut to fill the gap. What is left at a task's end is dealt into power-of-two sequences, which need
no padding.

Defined cases: null and empty texts are one token (the end id); repeated documents are packed each on its own;
documents longer than a sequence are cut; an empty table gives no rows; extra columns are ignored. A null id is
kept as null; limits below one are refused.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import small_batches

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "segment int, loss_tokens long")
CACHE = 1_500_000  # chunks kept by a worker

#: A word of Latin letters and the marks after it: two pre-tokens, that need no normalising but lower case.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")
#: The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SELF)}


class WordCache(dict):
    """Token ids, as little-endian uint32 bytes, of chunks between ASCII white space: token boundaries fall there."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        sample = ["Hello,", "\u00dcber!!", "na\u00efve", "a.b", "fin."]
        self.plain = all(self._pieces(PLAIN.fullmatch(x)) == self._whole(x) for x in sample if PLAIN.fullmatch(x))

    def _whole(self, chunk: str) -> list[int]:
        return self.t.encode(chunk, add_special_tokens=False).ids

    def _pieces(self, m) -> list[int]:
        """The model alone, without the tokenizer's normalising and splitting, which would cost several times as much."""
        word = m[1].lower()
        word = word if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET)
        return [x.id for x in self.model.tokenize(word)] + ([x.id for x in self.model.tokenize(m[2])] if m[2] else [])

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        m = PLAIN.fullmatch(text) if self.plain else None
        if m and (m[2] or not text.islower()):  # the word and its marks are looked up, as many chunks share them
            self[chunk] = v = self[m[1].lower().encode()] + (self[m[2].encode()] if m[2] else b"")
            return v
        ids = self._pieces(m) if m else self._whole(text)
        self[chunk] = v = struct.pack(f"<{len(ids)}I", *ids)
        return v

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class Packer:
    """Packs pieces that arrive one by one; memory is bounded by the pool."""

    def __init__(self, first_sequence: int, max_tokens=2048, max_segments=256, max_loss=2048, pool=512):
        if min(max_tokens, max_segments, max_loss, pool) < 1:
            raise ValueError("limits are one or more")
        self.limit = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.seq, self.pool = first_sequence, pool
        self.need = np.zeros((pool + 1, 3))
        self.items: list[list] = []  # [doc, start, end, loss_from, ids, total]
        self.rows: list[tuple] = []

    def _loss(self, it, end=None):
        return max(0, (it[2] if end is None else end) - max(it[1], it[3]))

    def add(self, doc, ids: bytes, loss_from: int = 0) -> None:
        n = len(ids) // 4
        it = [doc, 0, n, loss_from, ids, n]
        t, _, l = (int(x) for x in self.limit)
        while it[2] - it[1] >= t and self._loss(it, it[1] + t) <= l:
            self._emit([self._cut(it, t)])
        if it[2] > it[1]:
            self._put(it)
        while len(self.items) >= self.pool:
            self._bin()

    def _put(self, it) -> None:
        self.need[len(self.items)] = (it[2] - it[1], 1, self._loss(it))
        self.items.append(it)

    def _cut(self, it, n: int):
        piece = [it[0], it[1], it[1] + n, it[3], it[4], it[5]]
        it[1] += n
        return piece

    def _drop(self, i: int):
        it = self.items[i]
        last = self.items.pop()
        if last is not it:
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return it

    def _fill(self, limit: np.ndarray) -> list:
        """One bin by the dot-product rule."""
        left, out = limit.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.items)]
            fits = (need <= left).all(1)
            score = need @ (left / self.limit**2)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                out.append(it := self._drop(i))
                left -= (it[2] - it[1], 1, self._loss(it))
                continue
            i = int(score.argmax())
            it = self.items[i]
            n = int(min(left[0], max(0, it[3] - it[1]) + left[2], it[2] - it[1]))
            if n <= 0:
                break
            if n == it[2] - it[1]:
                piece = self._drop(i)
            else:
                piece = self._cut(it, n)
                self.need[i] = (it[2] - it[1], 1, self._loss(it))
            out.append(piece)
            left -= (n, 1, self._loss(piece))
        return out

    def _bin(self) -> None:
        self._emit(self._fill(self.limit))

    def _emit(self, pieces) -> None:
        at = 0
        for k, p in enumerate(pieces):
            n = p[2] - p[1]
            self.rows.append((p[0], p[1], n, zlib.crc32(p[4][p[1] * 4 : p[2] * 4]), p[5], self.seq, at, k, self._loss(p)))
            at += n
        self.seq += 1

    def close(self) -> None:
        t = self.limit[0]
        while self.items:
            need = self.need[: len(self.items)].sum(0)
            size = t if need[0] >= t else 2 ** int(np.log2(need[0]))
            self._emit(self._fill(np.array([size, *self.limit[1:]])))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) if rows else [()] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(cols)],
            names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, loss_from_col: str | None = None,
         pool: int = 512) -> DataFrame:
    """Pieces of sequences. loss_from_col: the first token of each text that bears loss (null, None: all do)."""
    from pyspark.sql import functions as F

    small_batches(df.sparkSession, 1000)
    Packer(0, max_tokens, max_segments, max_loss, pool)  # checks the limits
    cols = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"),
                     (F.col(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")).alias("loss"))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        cache = word_cache(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, max_loss, pool)
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            if len(cache) > CACHE:
                cache.clear()
            for doc, x, loss in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist()):
                packer.add(doc, cache.ids(x) + end, loss or 0)
            if packer.rows:
                yield packer.take()
        packer.close()
        if packer.rows:
            yield packer.take()

    return cols.mapInArrow(run, SCHEMA)


def op1_packing(spark, sf_dir):
    import public_tokenizers

    from tidemark.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
