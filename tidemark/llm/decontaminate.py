"""Benchmark decontamination by spaced-seed hashing.

Masks ignore some token positions; they are chosen so that every placement of the substitutions a window may have
leaves a hit. Test hashes are a sorted table; training texts are hashed under every mask and probed. Around every hit the test item is laid over the text and
windows of `window` tokens with at most `window - least` substitutions confirm an overlap.

The test side goes to the tasks in blocks of at most `block_tokens` tokens (its size is measured first), so what is
broadcast is bounded however large the benchmark is; each block is one scan of the texts.

Tokens are runs of ASCII letters and digits or non-ASCII characters, ASCII lower-cased. Defined cases: null and empty
texts and items have no tokens and match nothing; items shorter than a window must be found whole (with the same share
of substitutions, those of fewer than `shortest` tokens without any); repeated documents and items match alike; null
ids are ids like others, but equal to each other alone; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, NON_WORD, U64, mix, range_hashes, row_of, small_batches, spans, table, text_buffer

SCHEMA = "doc_id long, item_id long, overlap_tokens int, matched_tokens int, doc_start int, item_start int"


@functools.lru_cache(None)
def masks(n: int, changed: int, most: int = 6) -> tuple[str, ...]:
    """Masks (1 compares a token, 0 ignores it) of which one at least fits between the changed tokens, wherever up to
    `changed` of n tokens are: as many compared tokens as `most` masks allow, by greedy choice. Where that search is
    large, or finds none, the masks are runs of ones: of changed + 1 equal parts of the n tokens, one is unchanged."""
    if changed and math.comb(n, changed) << n < 1 << 22:
        sets = [sum(1 << i for i in c) for c in itertools.combinations(range(n), changed)]
        for weight in range(n - changed, 1, -1):
            found = []
            for span in range(weight, n + 1):
                for inner in itertools.combinations(range(1, span - 1), weight - 2):
                    m = 1 | 1 << (span - 1) | sum(1 << i for i in inner)
                    found.append((sum(1 << k for k, c in enumerate(sets) if any(not m << o & c for o in range(n - span + 1))), m))
            left, out = (1 << len(sets)) - 1, []
            while left and len(out) < most:
                hits, m = max(found, key=lambda f: (f[0] & left).bit_count())
                left &= ~hits
                out.append(f"{m:b}"[::-1])
            if not left:
                return tuple(out)
    return ("1" * (n // (changed + 1)),)


def needed(n: int, window: int, least: int, shortest: int) -> int:
    """Equal tokens that an item of n tokens must have in a window, or in all of it where it is shorter."""
    w = min(n, window)
    return w if n < shortest else -(-w * least // window)


def masked(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, salt * 0x51ED27 + 1, U64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * U64(0x9E3779B97F4A7C15) + words[j : j + n]
            h ^= h >> U64(32)
    return mix(h)


class Items:
    """A block of test items: tokens, and for every mask the sorted hashes with their places."""

    def __init__(self, ids, texts, window: int, least: int, shortest: int):
        buf, offs = text_buffer(pa.array(texts, pa.string()))
        buf = LOWER[buf]
        starts, ends, self.first = spans(buf, offs, NON_WORD)
        self.ids, self.words = list(ids), range_hashes(buf, starts, ends)
        self.window, rows, sizes = window, row_of(self.first, len(starts)), np.diff(self.first)
        # Items of a window or more are found by the masks of a window (None); shorter ones by masks of their own length.
        self.masks = []
        for n in sorted(set(np.minimum(sizes[sizes > 0], window).tolist())):
            self.masks += [(m, None if n == window else n) for m in masks(n, n - needed(n, window, least, shortest))]
        self.probes = []
        for k, (m, only) in enumerate(self.masks):
            h = masked(self.words, m, k)
            at = np.arange(len(h))
            ok = at + len(m) <= self.first[rows[at] + 1] if len(h) else np.zeros(0, bool)
            ok &= sizes[rows[at]] == only if only else sizes[rows[at]] >= window
            at = at[ok]
            order = np.argsort(h[at], kind="stable")
            self.probes.append((h[at][order], at[order]))
        self.rows = rows
        bits = np.zeros(1 << 22, bool)
        for h, _ in self.probes:
            bits[h >> U64(42)] = True
        self.bits = bits


def overlaps(words, first, items: Items, least: int, shortest: int):
    """(row, item row, window tokens, matched tokens, start in text, start in item) of confirmed overlaps, best each."""
    rows = row_of(first, len(words))
    found_p, found_q = [], []
    for k, (m, _) in enumerate(items.masks):
        keys, place = items.probes[k]
        if not len(keys) or len(words) < len(m):
            continue
        h = masked(words, m, k)
        at = np.flatnonzero(items.bits[h >> U64(42)])
        at = at[at + len(m) <= first[rows[at] + 1]]
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        n = hi - lo
        if n.any():
            found_p.append(np.repeat(at, n))
            found_q.append(place[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    if not found_p:
        return []
    p, q = np.concatenate(found_p), np.concatenate(found_q)
    r, i = rows[p], items.rows[q]
    diag = (p - first[r]) - (q - items.first[i])
    u = np.unique(np.stack([r, i, diag], 1), axis=0)
    best: dict = {}
    for r, i, d in u.tolist():
        doc, item = words[first[r] : first[r + 1]], items.words[items.first[i] : items.first[i + 1]]
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = doc[lo + d : hi + d] == item[lo:hi]
        w = min(items.window, len(item))
        need = needed(len(item), items.window, least, shortest)
        if len(same) < w:
            continue
        c = np.concatenate(([0], np.cumsum(same)))
        ok = np.flatnonzero(c[w:] - c[:-w] >= need)
        if not len(ok):
            continue
        cover = np.zeros(len(same) + 1, np.int32)
        np.add.at(cover, ok, 1)
        np.add.at(cover, ok + w, -1)
        cover = np.cumsum(cover)[:-1] > 0
        got = (int(cover.sum()), int((cover & same).sum()), int(lo + d + ok[0]), int(lo + ok[0]))
        if (r, i) not in best or got > best[r, i]:
            best[r, i] = got
    return [(r, i, *v) for (r, i), v in best.items()]


def find_overlaps(docs: DataFrame, bench: DataFrame, window: int = 13, least: int = 10, shortest: int = 8, block_tokens: int = 1_000_000,
                  id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """One row per document and test item that overlap, with the longest confirmed overlap."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    bench = bench.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_tokens)))  # a token takes two characters at least, with its separator
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("t", "ascending")])
        shared = spark.sparkContext.broadcast(Items(part["item_id"].to_pylist(), part["t"].to_pylist(), window, least, shortest))

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                got = []
                for lo in range(0, b.num_rows, 250):
                    buf, offs = text_buffer(b.column(1).slice(lo, 250))
                    buf = LOWER[buf]
                    starts, ends, first = spans(buf, offs, NON_WORD)
                    ids = b.column(0).slice(lo, 250).to_pylist()
                    for r, i, *v in overlaps(range_hashes(buf, starts, ends), first, items, least, shortest):
                        got.append((ids[r], items.ids[i], *v))
                cols = list(zip(*got)) if got else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 2 else pa.int32()) for j, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        one = docs.mapInArrow(run, SCHEMA)
        out = one if out is None else out.unionByName(one)
    best = F.max(F.struct("overlap_tokens", "matched_tokens", F.negative("doc_start").alias("a"), F.negative("item_start").alias("b"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.overlap_tokens", "m.matched_tokens", F.negative("m.a").alias("doc_start"), F.negative("m.b").alias("item_start"))


def op8_decontamination(spark, sf_dir):
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
