"""Language identification by a byte convolutional network trained in numpy.

Filters of widths 2, 4 and 6 over byte embeddings, max pooling over fixed windows, a softmax layer. Because a
filter is linear in one-hot bytes, inference looks up byte-pair tables (65,536 x filters) instead of multiplying.
A document's probabilities are the means over all its windows, weighted by their bytes.

Defined cases: null texts and texts without a letter are `und` with score 0; ties between languages go to the
first in order of name; an empty or unlabelled table trains no model and everything is `und`; extra columns and
repeated rows are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, small_batches, table, text_buffer

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 4, 6), 16, 8
PAD = max(WIDTHS) - 1


def windows(buf: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of WINDOW bytes from the positions at[:, 0], at most at[:, 1] of them, then zeros."""
    idx = at[:, :1] + np.arange(WINDOW)
    out = np.zeros((len(at), WINDOW + PAD), np.uint8)
    ok = np.arange(WINDOW) < at[:, 1:2]
    out[:, :WINDOW] = np.where(ok, buf[np.minimum(idx, max(len(buf) - 1, 0))], 0) if len(buf) else 0
    return fold(out)


def fold(x: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the Latin letters that UTF-8 writes as C3 80 .. C3 9E."""
    x = LOWER[x]
    x[:, 1:] += ((x[:, :-1] == 0xC3) & (x[:, 1:] >= 0x80) & (x[:, 1:] <= 0x9E)).astype(np.uint8) * np.uint8(32)
    return x


class ByteConv:
    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.emb = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.w = [r.normal(0, (2 / (k * EMBED)) ** 0.5, (k, EMBED, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.d = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)

    def params(self):
        return [self.emb, *self.w, *self.b, self.d, self.c]

    def _forward(self, x):
        pooled, where = [], []
        for w, b, k in zip(self.w, self.b, WIDTHS):
            tabs = np.einsum("be,kef->kbf", self.emb, w)
            conv = b + sum(tabs[j][x[:, j : j + WINDOW]] for j in range(k))
            i = conv.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(conv, i[:, None], 1)[:, 0], 0))
            where.append(i)
        h = np.concatenate(pooled, 1)
        z = h @ self.d + self.c
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return h, where, p / p.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 3):
        r = np.random.default_rng(seed)
        ps = self.params()
        m, v, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for s in range(0, len(x), batch):
                xb, yb = x[order[s : s + batch]], y[order[s : s + batch]]
                h, where, p = self._forward(xb)
                g = p.copy()
                g[np.arange(len(yb)), yb] -= 1
                g /= len(yb)
                gd, gc, gh = h.T @ g, g.sum(0), (g @ self.d.T) * (h > 0)
                gemb, gw, gb = np.zeros_like(self.emb), [], []
                for n, (w, k, i) in enumerate(zip(self.w, WIDTHS, where)):
                    q = gh[:, n * FILTERS : (n + 1) * FILTERS]
                    gb.append(q.sum(0))
                    gk = np.zeros_like(w)
                    for j in range(k):
                        byte = np.take_along_axis(xb, i + j, 1)  # rows x filters
                        e = self.emb[byte]
                        gk[j] = np.einsum("bf,bfe->ef", q, e)
                        np.add.at(gemb, byte.ravel(), (q[..., None] * w[j].T[None]).reshape(-1, EMBED))
                    gw.append(gk)
                step += 1
                for k, (p_, g_) in enumerate(zip(ps, [gemb, *gw, *gb, gd, gc])):
                    m[k] = 0.9 * m[k] + 0.1 * g_
                    v[k] = 0.999 * v[k] + 0.001 * g_ * g_
                    p_ -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        out = []
        for w, b, k in zip(self.w, self.b, WIDTHS):
            t = np.einsum("be,kef->kbf", self.emb, w)
            out.append([(t[j][:, None] + t[j + 1][None] + (b if j == 0 else 0)).reshape(65536, FILTERS).astype(np.float32) for j in range(0, k, 2)])
        return out

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Class probabilities of windows, by pair tables and a pairwise maximum."""
        n = len(x)
        out = np.empty((n, len(self.classes)), np.float32)
        for s in range(0, n, 64):
            part = x[s : s + 64].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            h = []
            for tabs in tables:
                conv = tabs[0].take(pairs[:, :WINDOW], 0)
                for j, t in enumerate(tabs[1:], 1):
                    conv += t.take(pairs[:, 2 * j : 2 * j + WINDOW], 0)
                while conv.shape[1] > 1:
                    half = conv.shape[1] // 2
                    conv = np.maximum(conv[:, :half], conv[:, half:])
                h.append(np.maximum(conv[:, 0], 0))
            z = np.concatenate(h, 1) @ self.d + self.c
            z = np.exp(z - z.max(1, keepdims=True))
            out[s : s + 64] = z / z.sum(1, keepdims=True)
        return out


def labelled_sample(docs: DataFrame, per_language: int, max_bytes: int, languages: int) -> pd.DataFrame:
    """Up to about per_language texts of every language, chosen by a hash of the id: bounded, whatever the input."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages are labelled; give a larger bound")
    if not sizes:
        return pd.DataFrame({"text": [], "lang": []})
    rate = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_language / n))])
    pick = docs.where((F.length("text") < max_bytes) & (F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000))
    return pick.select("text", "lang", "doc_id").limit(2 * per_language * len(sizes)).toPandas().sort_values(["doc_id", "text"])


def train(docs: DataFrame, per_language: int = 500, windows_per_text: int = 4, max_bytes: int = 200_000, languages: int = 2000) -> ByteConv | None:
    """docs: doc_id, text, lang, all of which may be learned from. The sample bound is per_language texts (at most
    2 x in total over languages) of fewer than max_bytes characters, windows_per_text windows from each. Every labelled
    language is learned; more than `languages` of them are refused."""
    got = labelled_sample(docs.where("text is not null and lang is not null"), per_language, max_bytes, languages)
    if not len(got):
        return None
    classes = sorted(got["lang"].unique())
    buf, offs = text_buffer(pa.array(got["text"]))
    r = np.random.default_rng(5)
    at, y = [], []
    for i, lang in enumerate(got["lang"]):
        n = int(offs[i + 1] - offs[i])
        for s in {int(v) for v in r.integers(0, max(1, n - WINDOW), windows_per_text)}:
            if n:
                length = min(WINDOW, n - s) if r.random() < 0.7 else min(int(r.integers(16, WINDOW)), n - s)
                at.append((offs[i] + s, length))
                y.append(classes.index(lang))
    x = windows(buf, offs, np.array(at, np.int64).reshape(-1, 2))
    return ByteConv(classes).fit(x, np.array(y))


def identify(df: DataFrame, model: ByteConv | None, text_col: str = "text", names=("lang_pred", "score")) -> DataFrame:
    """df with two more columns; names that df already has are replaced."""
    spark = df.sparkSession
    small_batches(spark, 1000)
    keep = [c for c in df.columns if c not in names]
    df = df.select(*keep, F.col(text_col).rlike(r"\p{L}").alias("__letter"), F.col(text_col).cast("string").alias("__text"))
    shared = spark.sparkContext.broadcast(model)
    local: dict = {}

    def run(batches):
        net = shared.value
        if net is not None and "t" not in local:
            local["t"] = net.tables()
        for b in batches:
            buf, offs = text_buffer(b.column(len(keep) + 1))
            n = len(offs) - 1
            letter = np.asarray(b.column(len(keep)).fill_null(False)) if n else np.zeros(0, bool)
            prob = np.zeros((n, len(net.classes) if net else 1), np.float64)
            if net is not None and n:
                for lo in range(0, n, 100):  # a few texts at a time, and long ones in pieces
                    hi = min(n, lo + 100)
                    counts = np.where(letter[lo:hi], -(-(offs[lo + 1 : hi + 1] - offs[lo:hi]) // WINDOW), 0)
                    row = np.repeat(np.arange(lo, hi), counts)
                    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                    start = offs[row] + k * WINDOW
                    length = np.minimum(offs[row + 1] - start, WINDOW)
                    for s in range(0, len(row), 4096):
                        at = np.stack([start[s : s + 4096], length[s : s + 4096]], 1)
                        p = net.predict(windows(buf, offs, at), local["t"])
                        np.add.at(prob, row[s : s + 4096], p * at[:, 1:])
            total = prob.sum(1)
            seen = letter & (total > 0)
            best = prob.argmax(1)
            lang = np.where(seen, np.array(net.classes if net else ["und"], object)[best], "und")
            score = np.where(seen, prob.max(1, initial=0) / np.maximum(total, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*[df.schema[c] for c in keep], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return df.mapInArrow(run, out)


def held_out(divisor: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), model).drop("text")
