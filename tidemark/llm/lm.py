"""Cross-entropy difference: two n-gram models, target and background, over one vocabulary.

Words and pairs of following words are counted exactly over all documents, by 64-bit hashes; what is gathered grows with the
corpus and is never broadcast or sent to the driver.

1. Documents are written once with their side and a chunk number (about 8 MB of text each).
2. Each chunk sends every word and pair it has once, by hash, with its counts on both sides, packed by ranges of hashes; a
   frequent word has one entry a chunk, however often it occurs. Ranges hold about two million keys. Beyond some 500 GB of
   text, chunks and ranges both grow with the square root of the corpus, so a packed row never shrinks to a few keys.
3. The sums return to the chunks in the order of the keys that they sent, without the keys, which the chunks know; the chunks
   then score their documents.

Every document is scored by the models of all other documents: its own counts are taken off its side. So a word or pair that
one document alone has bears on no score, and sums that say no more than that need not return. The shared vocabulary is every
word of the other documents; a word outside it has difference 0. The models are matched: one vocabulary, order and smoothing,
and the background's counts are scaled to the target's number of tokens. Per side s, with pool(w) the word's share of all
tokens, both without the document scored:

    p_s(w) = 0.9 n_s(w) / N + 0.1 pool(w)          p_s(w | v) = (n_s(v w) + 5 p_s(w)) / (n_s(v) + 5)

score = mean over tokens of (loss under target - loss under background); lower is more like the target.

Defined cases: null and empty texts have no tokens and score 0; a document without target (or background) tokens besides its
own scores 0; repeated rows count and score each on its own; a null doc_id is background; an empty table gives no rows; labels
without a document are unused; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, LOWER, NON_WORD, U64, in_bitmap, mix, partitions_for, range_hashes, row_of, small_batches, spans, stage, table, text_buffer

CHUNK = 8 << 20
DOCS = 200  # texts hashed at a time
RANGE = 1 << 21  # words and pairs that meet in one range of hashes at most, about
ROW = 64  # keys of a packed row at least, on average
POOL, PRIOR = 0.1, 5.0


def grams(col):
    """(hash of each word, hash of the pair it ends, whether there is one, first word of each row)."""
    buf, offs = text_buffer(col)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offs, NON_WORD)
    words = range_hashes(buf, starts, ends)
    inner = np.ones(len(words), bool)
    inner[first[:-1][first[:-1] < len(words)]] = False
    prev = np.concatenate((words[:1], words[:-1]))
    return words, mix(prev * U64(0x9E3779B97F4A7C15) + words + U64(1)), inner, first


def sided(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text, side: 0 for the target's documents, 1 for others. A bitmap of bounded size spares most others the join."""
    ids = target.select("doc_id").where("doc_id is not null").distinct()
    maybe = in_bitmap(docs.sparkSession, Bitmap.build(ids.select(F.xxhash64("doc_id").alias("h")), "h", 24))
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("maybe", maybe(F.xxhash64("doc_id")))
    hit = marked.where("maybe").join(ids.withColumn("t", F.lit(0)).hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("t", F.lit(1)).alias("side"))
    return hit.unionByName(marked.where("not maybe").select("doc_id", "text", F.lit(1).alias("side")))


def growth(n: int) -> float:
    """By how much chunks and ranges grow for n words and pairs, so that a chunk has ROW keys in a range. A chunk of CHUNK
    bytes has about a third as many words and pairs."""
    return max(1.0, (ROW * n / max(1.0, CHUNK / 3 * RANGE)) ** 0.5)


def chunked(marked: DataFrame, size_of: int) -> DataFrame:
    """marked with the number of its chunk and of its tokens, written once, so that both passes see the same chunks."""
    kind = marked.schema["doc_id"].dataType.simpleString()

    def number(batches):
        from pyspark import TaskContext

        at, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                part = b.slice(lo, DOCS)
                first = grams(part.column(1))[3]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, at)), pa.array(np.diff(first).astype(np.int64))], names=["doc_id", "text", "side", "chunk", "n_tokens"])
                size += part.column(1).nbytes
                if size >= size_of:
                    at, size = at + 1, 0

    return stage(marked.mapInArrow(number, f"doc_id {kind}, text string, side int, chunk long, n_tokens long"), "lm-chunks")


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, no more than the largest needs."""
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([n]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def whole(data: bytes) -> np.ndarray:
    n = data[0]
    out = np.zeros(((len(data) - 1) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1).T
    return out.reshape(-1).view("<u8")


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as planes of their differences."""
    return planes(np.diff(keys, prepend=U64(0)))


PACK = "range long, chunk long, k binary, t binary, b binary"
NAMES = [x.split()[0] for x in PACK.split(", ")]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


class Chunk:
    """The texts of a chunk as words and pairs: `keys`, sorted and distinct, and by slices of texts (`parts`) the places of each
    in them. Both passes make the same keys of the same texts, in whatever order these come."""

    def __init__(self, parts: list):
        """parts: (text column, side column)."""
        held = [(*grams(t), np.asarray(s)) for t, s in parts]
        all_ = [x for w, p, inner, *_ in held for x in (w, p[inner])]
        self.keys, at = np.unique(np.concatenate(all_) if all_ else np.zeros(0, U64), return_inverse=True)
        at = at.astype(np.int32)
        del all_
        self.parts, lo = [], 0
        for words, _, inner, first, sides in held:
            n, m = len(words), int(inner.sum())
            pair = np.zeros(n, np.int32)
            pair[inner] = at[lo + n : lo + n + m]
            self.parts.append((at[lo : lo + n], pair, inner, first, sides))
            lo += n + m

    def counts(self):
        """Of each key, its number in texts of the target and of the background."""
        out = np.zeros((2, len(self.keys)), np.int64)
        for word, pair, inner, first, sides in self.parts:
            side = sides[row_of(first, len(word))]
            for s in (0, 1):
                np.add.at(out[s], word[side == s], 1)
                np.add.at(out[s], pair[(side == s) & inner], 1)
        return out

    def gains(self, n: np.ndarray, n_target: int, n_background: int):
        """Of each part, per text: tokens, and the sum of their losses under the target less those under the background. n:
        counts of the keys, both sides in rows."""
        for word, pair, inner, first, sides in self.parts:
            rows, length = row_of(first, len(word)), np.diff(first)
            total = np.array([[n_target], [n_background]], float).repeat(len(sides), 1)
            total[sides, np.arange(len(sides))] -= length
            yield length, np.bincount(rows, self._gains(word, pair, inner, rows, sides[rows], n, total[:, rows]), len(sides)) if len(rows) else np.zeros(len(sides))

    def _own(self, rows, at, ok):
        """How often the text of each token has the key of the token."""
        out = np.zeros(len(at), np.int64)
        if ok.any():
            _, i, n = np.unique(rows[ok] * np.int64(len(self.keys)) + at[ok], return_inverse=True, return_counts=True)
            out[ok] = n[i]
        return out

    def _gains(self, word, pair, inner, rows, mine, n, total):
        known = (total > 0).all(0)
        total = np.maximum(total, 1.0)
        own = self._own(rows, word, np.ones(len(word), bool)), self._own(rows, pair, inner)
        one, two = (np.stack([n[s, at] - np.where(mine == s, x, 0) for s in (0, 1)]).astype(float) for at, x in zip((word, pair), own))
        pool = one.sum(0) / total.sum(0)
        seen = (pool > 0) & known
        follows = np.concatenate((np.zeros(1, bool), seen[:-1])) & inner
        p = []
        for s in (0, 1):
            scale = total[0] / total[s]
            flat = (1 - POOL) * one[s] * scale / total[0] + POOL * pool
            before = np.concatenate((np.zeros(1), (one[s] * scale)[:-1]))
            p.append(np.where(follows, (two[s] * scale + PRIOR * flat) / (before + PRIOR), flat))
        return np.where(seen, np.log(np.where(seen, p[1], 1.0)) - np.log(np.where(seen, p[0], 1.0)), 0.0)


def by_chunk(batches, at: int):
    """(chunk, batches of its rows), one chunk after another; `at`: the column of the chunk."""
    now, held = None, []
    for b in batches:
        chunk = np.asarray(b.column(at))
        cut = np.flatnonzero(np.diff(chunk)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            if hi == lo:
                continue
            if chunk[lo] != now:
                if held:
                    yield now, held
                now, held = int(chunk[lo]), []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def counts(docs: DataFrame, ranges: int) -> DataFrame:
    """Packed rows (range, chunk, k, t, b): for the keys that a chunk has in a range, in their order, a bit whether their sums
    go beyond the chunk's text that has them (k), and these sums on both sides (t, b). A range is the first `ranges` bits."""
    wide = U64(64 - ranges)

    def local(batches):
        for number, held in by_chunk(batches, 2):
            c = Chunk([(b.column(0).slice(i, DOCS), b.column(1).slice(i, DOCS)) for b in held for i in range(0, b.num_rows, DOCS)])
            t, g = c.counts()
            ids, lo = np.unique(c.keys >> wide, return_index=True)
            hi = np.append(lo[1:], len(c.keys))
            for k in range(0, len(ids), 64):
                yield rows_of([(int(r), number, steps(c.keys[i:j]), planes(t[i:j]), planes(g[i:j])) for r, i, j in zip(ids[k : k + 64], lo[k : k + 64], hi[k : k + 64])])

    def answer(held):
        parts = [(c, np.cumsum(whole(k)), whole(t), whole(b)) for c, k, t, b in held]
        keys, at = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
        t, b = (np.bincount(at, np.concatenate([x[i] for x in parts]), len(keys)).astype(np.int64) for i in (2, 3))
        live = t + b > 1
        lo = 0
        for c, k, _, _ in parts:
            i = at[lo : lo + len(k)]
            lo += len(k)
            some = live[i]
            yield c, planes(np.array([len(k)])) + np.packbits(some).tobytes(), planes(t[i[some]]), planes(b[i[some]])

    def total(batches):
        for r, held in by_chunk(batches, 0):
            rows = [row for b in held for row in zip(*(c.to_pylist() for c in b.columns[1:]))]
            for x in answer(rows):
                yield rows_of([(r, *x)])

    asked = docs.select("text", "side", "chunk").mapInArrow(local, PACK)
    return asked.repartition(partitions_for(docs.sparkSession), "range").sortWithinPartitions("range").mapInArrow(total, PACK)


def answered(c: Chunk, rows: list[tuple]) -> np.ndarray:
    """The sums of a chunk's keys on both sides. A key without an answer is in one text alone, once."""
    n, at = c.counts(), 0
    for _, k, t, b in sorted(rows):
        size = int(whole(k[: 1 + k[0]])[0])
        live = np.flatnonzero(np.unpackbits(np.frombuffer(k, np.uint8, offset=1 + k[0]), count=size)) + at
        n[0, live], n[1, live] = whole(t), whole(b)
        at += size
    if at != len(c.keys):
        raise RuntimeError("the answers to a chunk do not fit its keys")
    return n


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score, target_like (score < 0). docs: doc_id, text; target: doc_id of the target's documents, the
    others are the background."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    known = chunked(sided(docs, target), int(CHUNK * growth(size // 3)))
    total = dict.fromkeys((0, 1), 0) | {r.side: r.n for r in known.groupBy("side").agg(F.sum("n_tokens").alias("n")).collect()}
    n = max(2 * sum(total.values()), 1)
    ranges = max(4, (int(n / (RANGE * growth(n))).bit_length()), (4 * partitions_for(spark)).bit_length())
    sums = counts(known, ranges)

    def run(batches):
        for _, held in by_chunk(batches, 0):
            rows, texts = [], []
            for b in held:
                is_text = np.asarray(b.column(1)).astype(bool)
                texts += [b.filter(pa.array(is_text)).slice(i, DOCS) for i in range(0, int(is_text.sum()), DOCS)]
                rows += zip(*(b.filter(pa.array(~is_text)).column(i).to_pylist() for i in range(5, 9)))
            c = Chunk([(b.column(3), b.column(4)) for b in texts])
            for b, (n, s) in zip(texts, c.gains(answered(c, rows), total[0], total[1])):
                v = np.round(s / np.maximum(n, 1), 9)
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(n.astype(np.int64)), pa.array(v), pa.array(v < 0)], names=["doc_id", "n_tokens", "score", "target_like"])

    none = lambda t: F.lit(None).cast(t)
    texts = known.select("chunk", F.lit(1).alias("is_text"), "doc_id", "text", "side", none("long").alias("range"), *[none("binary").alias(c) for c in "ktb"])
    tables = sums.select("chunk", F.lit(0).alias("is_text"), none(kind).alias("doc_id"), none("string").alias("text"), none("int").alias("side"), "range", *"ktb")
    met = tables.unionByName(texts).repartition(partitions_for(spark), "chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double, target_like boolean")


def op4_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return score(docs, good)
