"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features come from vectorised word hashes: densities of a lexicon learned from labelled texts (whole words and word
beginnings), its density after undoing digit-for-letter and symbol obfuscation, nearness to second-person words,
capitals, punctuation, and obfuscated words. The labelled sample is bounded by two parameters: about `texts` rows, of fewer
than `max_chars` characters each; all texts are scored whole. A score is 0.97 of the isotonic value and 0.03 of the
uncalibrated one, which orders the texts of one step.

Defined cases: null and empty texts get the score of a text without words; without labels of both kinds every score
is 0; ties and repeated rows score alike; extra columns are ignored; labels without a document are unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, NON_WORD, WHITE, U64, range_hashes, row_of, small_batches, spans, table, text_buffer
from tidemark.llm.jaccard import embed, short
from tidemark.llm.language import held_out

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = ("you your yours yourself ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
                 "usted ustedes tus tuyo vosotros os").split()
# Characters that stand for letters in obfuscated words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
PREFIXES = (4, 5, 6)
NAMES = ("log_words lexicon_count lexicon_density strong_count strong_density distinct_hits best_window near_second second_density "
         "capitals shouted exclamations questions punctuation digits obfuscated obfuscated_hits repeats mean_length").split()
_LEET = LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_CORE = NON_WORD.copy()
for _a in set(LEET) - {"!"}:
    _CORE[ord(_a)] = False


def hash_words(words) -> np.ndarray:
    buf, offs = text_buffer(pa.array([w.encode() for w in words], pa.binary()))
    return range_hashes(buf, offs[:-1], offs[1:])


SECOND = np.sort(hash_words(SECOND_PERSON))


def member(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    i = np.searchsorted(sorted_keys, h)
    return sorted_keys[np.minimum(i, len(sorted_keys) - 1)] == h


def units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a beginning as long as the word is the word's own hash."""
    return [range_hashes(buf, starts, ends)] + [range_hashes(buf, starts, np.minimum(ends, starts + k)) for k in PREFIXES]


def learn_lexicon(texts: list, toxic: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Units (sorted hashes) that mark toxic texts, and the strong ones among them. Units are first taken from the toxic
    texts; the others are only probed for them, so memory follows the toxic share of a bounded sample. Each unit is in one
    of 60 toxic texts at least, so the lexicon has no more than 60 texts' worth of units."""
    toxic = np.asarray(toxic) > 0
    if not toxic.any():
        return np.zeros(0, U64), np.zeros(0, U64)
    # Copies and near copies of one toxic text would make all its words look toxic: one of each group counts.
    found, seen = [], []
    for u in unit_sets([t for t, x in zip(texts, toxic) if x]):
        if len(u):
            sig = short(embed(u))
            if not any((sig == s).mean() > 0.4 for s in seen):
                seen.append(sig)
                found.append(u)
    if not found:
        return np.zeros(0, U64), np.zeros(0, U64)
    least = max(least, len(found) // 60)
    h, bad = np.unique(np.concatenate(found), return_counts=True)
    h, bad = h[bad >= least], bad[bad >= least]
    good = np.zeros(len(h), np.int64)
    for u in unit_sets([t for t, x in zip(texts, toxic) if not x]):
        good[np.searchsorted(h, u[member(h, u)])] += 1
    share = max(len(found) / (len(found) + (~toxic).sum()), 1e-6)
    odds = ((bad + 0.2) / share) / ((good + 0.2) / max(1 - share, 1e-6))
    pick = np.flatnonzero(odds > 30)
    return np.sort(h[pick]), np.sort(h[pick[odds[pick] > 100]])


def unit_sets(texts: list):
    """The distinct units of each text."""
    for lo in range(0, len(texts), 100):
        buf, offs = text_buffer(pa.array(texts[lo : lo + 100], pa.string()))
        buf = _LEET[buf]
        starts, ends, first = spans(buf, offs, NON_WORD)
        us = units(buf, starts, ends)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(np.concatenate([u[a:b] for u in us]))


def features(buf: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, strong: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    if n == 0:
        return out
    size = np.diff(offs).astype(np.float64)
    per_byte = np.maximum(size, 1)

    def bytes_where(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[offs[1:]] - c[offs[:-1]]

    low = LOWER[buf]
    starts, ends, first = spans(low, offs, NON_WORD)
    rows = row_of(first, len(starts))
    words = np.maximum(np.diff(first), 1).astype(np.float64)
    count = lambda m, w=None: np.bincount(rows[m] if w is None else rows, weights=w, minlength=n)[:n]
    hashes = units(low, starts, ends)
    hit, sure = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for h in hashes:
        hit |= member(lexicon, h)
        sure |= member(strong, h)
    second = member(SECOND, hashes[0])
    near = np.zeros(len(starts), bool)
    if len(starts):
        at = np.concatenate(([0], np.cumsum(second)))
        lo, hi = np.maximum(np.arange(len(starts)) - 5, first[rows]), np.minimum(np.arange(len(starts)) + 6, first[rows + 1])
        near = hit & (at[hi] > at[lo])
    # obfuscated words: cores that mix letters with digits or symbols
    s2, e2, f2 = spans(low, offs, _CORE)
    odd = np.zeros(len(s2), bool)
    if len(s2):
        alpha = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) | (low >= 128))))
        other = (e2 - s2) - (alpha[e2] - alpha[s2])
        odd = (other > 0) & (alpha[e2] - alpha[s2] >= 2) & (e2 - s2 <= 40)
    r2 = row_of(f2, len(s2))[odd]
    plain = _LEET[buf]
    odd_hit = np.zeros(int(odd.sum()), bool)
    if odd.any():
        for h in units(plain, s2[odd], e2[odd]):
            odd_hit |= member(strong, h)
    upper = (buf >= 65) & (buf <= 90)
    caps = np.concatenate(([0], np.cumsum(upper)))
    shout = (ends - starts > 1) & (caps[ends] - caps[starts] == ends - starts)
    hits, sures = count(hit), count(sure)
    best = np.zeros(n)
    if hit.any():
        c = np.concatenate(([0], np.cumsum(hit | sure)))
        i = np.flatnonzero(hit)
        np.maximum.at(best, rows[i], (c[np.minimum(i + 30, first[rows[i] + 1])] - c[i]).astype(float))
    distinct = np.zeros(n)
    if hit.any():
        u = np.unique(np.rec.fromarrays([rows[hit], hashes[0][hit]], names="d,h"))
        distinct = np.bincount(u.d, minlength=n).astype(float)
    again = np.zeros(len(buf), bool)
    if len(buf) > 2:
        again[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (low[2:] >= 97)
    cols = [np.log1p(np.diff(first)), np.log1p(hits), hits / words, np.log1p(sures), sures / words, np.log1p(distinct), best, np.log1p(count(near)),
            count(second) / words, bytes_where(upper) / per_byte, count(shout) / words, bytes_where(buf == 33) / per_byte, bytes_where(buf == 63) / per_byte,
            bytes_where(NON_WORD[buf] & ~WHITE[buf]) / per_byte, bytes_where((buf >= 48) & (buf <= 57)) / per_byte,
            np.bincount(r2, minlength=n) / words, np.log1p(np.bincount(r2[odd_hit], minlength=n)), bytes_where(again) / per_byte, size / words]
    for k, c in enumerate(cols):
        out[:, k] = c
    return out


class Trees:
    """Histogram gradient boosting with logistic loss."""

    def __init__(self, rounds=80, depth=3, rate=0.15, bins=32, least=8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x, y):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        z = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree, node = {}, np.ones(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    cut = self._best(b, g, h, rows) if len(rows) >= 2 * self.least else None
                    if cut:
                        f, t = cut
                        tree[k] = (f, float(self.edges[f][t]))
                        node[rows] = 2 * k + (b[rows, f] > t)
                    else:
                        node[rows] = k << (self.depth - level)
                        tree[k] = None
            lead = node
            size = 2 ** (self.depth + 1)
            value = np.bincount(lead, g, size)[:size] / (np.bincount(lead, h, size)[:size] + 1.0)
            self.trees.append((tree, value * self.rate))
            z += value[lead] * self.rate
        return self

    def _best(self, b, g, h, rows):
        best, found = 1e-6, None
        G, H = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(self.edges):
            if not len(e):
                continue
            m = len(e) + 1
            k = b[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(k, w, m))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
            t = int(gain.argmax())
            if gain[t] > best:
                best, found = gain[t], (f, t)
        return found

    def margin(self, x):
        z = np.full(len(x), self.start)
        for tree, value in self.trees:
            node = np.ones(len(x), np.int64)
            for level in range(self.depth):
                nxt = node * 2
                for k in range(2**level, 2 ** (level + 1)):
                    cut = tree.get(k)
                    if cut:
                        rows = node == k
                        nxt[rows] += x[rows, cut[0]] > cut[1]
                node = nxt
            z += value[node]
        return z


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: step positions and values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][2] = s2
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.02) / (b[1] + 0.04) if b[1] < 3 else b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, texts, toxic):
        toxic = np.asarray(toxic, float)
        r = np.random.default_rng(11).permutation(len(texts))
        a, b = r[: len(r) // 2], r[len(r) // 2 :]
        x, y = [], []
        for own, other in ((a, b), (b, a)):  # each half's features from the other half's lexicon
            lex = learn_lexicon([texts[i] for i in other], toxic[other])
            x += [features(*text_buffer(pa.array([texts[i] for i in own[lo : lo + 200]], pa.string())), *lex) for lo in range(0, len(own), 200)]
            y.append(toxic[own])
        x, y = np.concatenate(x), np.concatenate(y)
        mixed = np.random.default_rng(12).permutation(len(y))
        x, y = x[mixed], y[mixed]
        self.lexicon, self.strong = learn_lexicon(texts, toxic)
        cut = len(y) * 2 // 3
        self.trees = Trees().fit(x[:cut], y[:cut])
        z = self.trees.margin(x[cut:])
        self.at, self.value = isotonic(z, y[cut:])

    def score(self, buf, offs):
        z = self.trees.margin(features(buf, offs, self.lexicon, self.strong))
        p = self.value[np.minimum(np.searchsorted(self.at, z, "left"), len(self.at) - 1)]
        return np.clip(0.97 * p + 0.03 / (1 + np.exp(-z)), 0, 1)  # the small share orders texts of one step


def train(labelled: DataFrame, documents: DataFrame, texts: int = 5000, max_chars: int = 60_000) -> Model | None:
    """labelled: doc_id, toxic of rows that may be learned from; at most about `texts` of them are read, and of these the
    texts of fewer than `max_chars` characters."""
    n = labelled.count()
    rate = min(1.0, texts / max(n, 1))
    ids = labelled.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).limit(2 * texts)
    got = documents.select("doc_id", "text").where(F.length("text") < max_chars).join(F.broadcast(ids), "doc_id").limit(2 * texts).toPandas()
    got = got.sort_values(["doc_id", "text"], kind="stable")
    if got["toxic"].nunique() < 2 or len(got) < 30:
        return None
    return Model(got["text"].tolist(), got["toxic"].to_numpy())


def score(df: DataFrame, model: Model | None, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(model)
    df = df.select(F.col(id_col).alias("doc_id"), held_out(4, 2).alias("held_out"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            got = [np.zeros(0)]
            for lo in range(0, n, 250):
                buf, offs = text_buffer(b.column(2).slice(lo, 250))
                got.append(m.score(buf, offs) if m else np.zeros(len(offs) - 1))
            s = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    usable = labels.where(~held_out(4, 2) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    return score(docs, train(usable, docs))
