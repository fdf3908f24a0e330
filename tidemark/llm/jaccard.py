"""Chosen-path Jaccard join over word shingles.

A document is the set of its five-word shingles (ASCII lower case, split at ASCII white space). Equal sets are one
class from the start. Every class embeds its set in 128 minimum hashes, the tokens that the join splits on:

1. Chosen path: in each run, a class follows every token whose hash under the path so far is below 1 / (t x similarity),
   so two sets of the wanted similarity share one path on average. Paths followed by one class alone end; paths of many
   are split again on further tokens, up to `depth` levels; small ones are compared by brute force on the embeddings. The
   number of runs follows from the target recall of a pair at the very threshold whose paths are split at every level.
   Only a spanning forest of the pairs that may be similar leaves a task. Sets of few shingles, whose embeddings say
   little, meet their neighbours exactly too: by the hash of the set less each one of its shingles.
2. The forest's components are candidates. Within a component all sets meet, whole, in blocks of bounded size, and the
   Jaccard similarity of each pair is computed exactly; a task returns, for each class, its number of links and a forest.

Nothing is dropped or capped: a path or component above the block size is dealt as pairs of blocks.

Defined cases: null texts and texts without a word are in no set and stand alone, without links; texts of fewer than
five words have one shingle, the whole; repeated rows (one doc_id) count as copies, and rows of one doc_id with differing
texts are one document, similar to whatever either text is similar to; rows with a null id stand alone; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, LOWER, U64, mix, partitions_for, range_hashes, signed, small_batches, spans, stage, table, text_buffer, window_hashes
from tidemark.llm.components import components

T = 128  # embedding size
FEW = 9  # shingles of a set whose neighbours by one shingle are found exactly
DEPTH = 3  # levels of paths


def shingle_sets(col, k: int):
    """Sorted distinct shingle hashes of every text."""
    buf, offs = text_buffer(col)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offs)
    words = range_hashes(buf, starts, ends)
    win = window_hashes(words, k)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(win[a : b - k + 1])
        elif b > a:
            yield mix(np.array([np.sum(words[a:b] * (np.arange(b - a, dtype=U64) * U64(2) + U64(3)))], U64) + U64(b - a))
        else:
            yield np.zeros(0, U64)


_EDGE = np.arange(T, dtype=U64) << U64(57)
_SLOT = mix(np.arange(T, dtype=U64) + U64(99))


def embed(s: np.ndarray) -> np.ndarray:
    """One-permutation minimum hashes; an empty slot borrows from the next full one."""
    at = np.searchsorted(s, _EDGE)
    v = s[np.minimum(at, len(s) - 1)]
    full = (at < len(s)) & (v >> U64(57) == np.arange(T, dtype=U64))
    pos = np.flatnonzero(full)
    src = pos[np.searchsorted(pos, np.arange(T)) % len(pos)]
    return mix(v[src] + ((np.arange(T) - src) % T).astype(U64) * U64(0x9E3779B97F4A7C15))


def short(v: np.ndarray) -> np.ndarray:
    """The embedding as it is compared: 16 bits a slot."""
    return (v & U64(0xFFFF)).astype(np.uint16)


def profiles(docs: DataFrame, k: int, similarity: float, recall: float) -> DataFrame:
    """doc_id, number of shingles, 128-bit set hash, embedding, the paths of every run's first level (chosen by the
    minimum hashes in full, so that texts without a common shingle do not meet), and the hashes of a small set less one
    shingle, where that is similar enough; sets without a shingle are left out."""
    small_batches(docs.sparkSession, 1000)
    start = mix(np.arange(runs_for(recall), dtype=U64) + U64(1))
    pair = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 200):
                ids = b.column(0).slice(lo, 200).to_pylist()
                for i, s in zip(ids, shingle_sets(b.column(1).slice(lo, 200), k)):
                    if len(s) and i is not None:
                        v = embed(s)
                        paths = follow(mix(v + _SLOT), start, similarity)[1]
                        h1, h2 = set_hashes(s)
                        k1, k2 = h1.sum(keepdims=True), h2.sum(keepdims=True)
                        less = zip(signed(k1 - h1).tolist(), signed(k2 - h2).tolist()) if len(s) <= FEW and len(s) - 1 >= similarity * len(s) else ()
                        out.append((i, len(s), int(signed(k1)[0]), int(signed(k2)[0]), short(v).tobytes(), signed(np.unique(paths)), [{"k1": x, "k2": y} for x, y in less]))
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pair])], names=["doc_id", "n", "k1", "k2", "sig", "paths", "less"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n int, k1 long, k2 long, sig binary, paths array<long>, less array<struct<k1:bigint,k2:bigint>>")


def set_hashes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every shingle; a set's own are their sums."""
    return mix(s), mix(s ^ U64(0xABCDEF))


def tokens(sig: bytes) -> np.ndarray:
    return mix(np.frombuffer(sig, np.uint16).astype(U64) + _SLOT)


def follow(tok: np.ndarray, paths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent path, child path) of every token chosen under each path."""
    h = mix(tok[None, :] ^ paths[:, None])
    i, j = np.nonzero(h < U64(int(2**64 / (T * similarity))))
    return i, mix(h[i, j] + paths[i] * U64(3))


def runs_for(recall: float, levels: int = DEPTH) -> int:
    """Runs after which a pair at the very threshold is found with this probability, if its paths are `levels` long."""
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def forest(pairs_i, pairs_j, ids):
    """Star edges to the least id of each group among linked positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(pairs_i.tolist(), pairs_j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            if ids[a] > ids[b]:
                a, b = b, a
            root[b] = a
    return [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i]


def blocks_of(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with columns bi, bj: 0, 0 for keys of up to `size` rows; larger keys are dealt as pairs of blocks, every two
    rows of the key meeting in a pair. The rows of a pair are at most about 2 x size."""
    large = stage(df.groupBy(key).count().where(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("nb")), "large-keys")
    mine = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    pairs = F.when(F.col("nb").isNull(), F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("blk")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, mine).alias("bi"), F.greatest(o, mine).alias("bj"), mine.alias("blk"))))
    return df.join(large.hint("merge"), key, "left").withColumn("p", F.explode(pairs)).select(*df.columns, "p.bi", "p.bj", "p.blk")


def grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(rows of one key as tuples) -> rows, one key after another; a task holds one key at a time."""
    at = [df.columns.index(k) for k in keys]
    types = [t.split()[1] for t in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[t]) for i, t in enumerate(types)], names=[t.split()[0] for t in schema.split(", ")])

    def run(batches):
        now, held, out = None, [], []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                k = [r[i] for i in at]
                if k != now:
                    if len(held) > 1:
                        out.extend(fn(held))
                    now, held = k, []
                held.append(r)
            yield pack(out)
            out = []
        if len(held) > 1:
            out.extend(fn(held))
        yield pack(out)

    return df.repartition(partitions_for(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def similar_forest(classes: DataFrame, similarity: float, bucket: int = 1500, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) of a forest that joins all classes that may be similar. classes: id, n, k1, k2, sig, paths, less."""

    def split(batches):
        for b in batches:
            ids, paths = [], []
            for i, sig, p in zip(b.column("id").to_pylist(), b.column("sig").to_pylist(), b.column("path").to_pylist()):
                _, child = follow(tokens(sig), np.array([p]).view(U64), similarity)
                ids.append(np.full(len(child), i, np.int64))
                paths.append(child)
            ids, paths = (np.concatenate(x) if x else np.zeros(0, U64) for x in (ids, paths))
            yield pa.RecordBatch.from_arrays([pa.array(signed(paths)), pa.array(ids.astype(np.int64))], names=["path", "id"])

    rows = classes.select(F.explode("paths").alias("path"), "id")
    leaves = None
    for level in range(1, depth + 1):
        sizes = stage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("path", "c"), "path-sizes")
        shared = stage(rows.join(sizes.hint("merge"), "path"), "paths-shared")
        small = (shared if level == depth else shared.where(F.col("c") <= bucket)).select("path", "id")
        leaves = small if leaves is None else leaves.union(small)
        large = shared.where(F.col("c") > bucket)
        if level == depth or large.isEmpty():
            break
        rows = stage(large.join(classes.select("id", "sig"), "id").select("id", "sig", "path").mapInArrow(split, "path long, id long").distinct(), "paths")

    def brute(held):
        ids = [r[1] for r in held]
        if len(set(ids)) < 2:
            return []
        n = np.array([r[5] for r in held])
        sig = np.frombuffer(b"".join(r[6] for r in held), np.uint16).reshape(len(held), T)
        left = np.arange(len(held))
        pi, pj = [], []
        # Whatever is joined to a pivot needs no second look at its own pairs: the forest has its component already.
        while len(left) > 1:
            p, rest = left[0], left[1:]
            bound = np.maximum(0.25, similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.minimum(T, np.minimum(n[p], n[rest]))))
            ok = (sig[rest] == sig[p]).mean(1) >= bound
            mates = rest[ok]
            pi.append(np.full(len(mates), p))
            pj.append(mates)
            left = rest[~ok]
            for m in mates if len(left) else ():  # the rest may be linked through a mate
                bound = np.maximum(0.25, similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.minimum(T, np.minimum(n[m], n[left]))))
                hit = left[(sig[left] == sig[m]).mean(1) >= bound]
                pi.append(np.full(len(hit), m))
                pj.append(hit)
        return forest(np.concatenate(pi), np.concatenate(pj), ids)

    dealt = blocks_of(stage(leaves, "leaves"), "path", bucket).join(classes.select("id", "n", "sig").hint("merge"), "id").select("path", "id", "bi", "bj", "blk", "n", "sig")
    one_less = classes.select(F.col("id").alias("a"), F.explode("less").alias("k")).select("a", "k.k1", "k.k2").join(classes.select(F.col("id").alias("b"), "k1", "k2").hint("merge"), ["k1", "k2"]).select("a", "b")
    return grouped(dealt, ["path", "bi", "bj"], brute, "a long, b long").unionByName(one_less).distinct()


def jaccard_matrix(sets) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that two sets or more have."""
    m = len(sets)
    h = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inv, cnt = np.unique(h, return_inverse=True, return_counts=True)
    many = cnt > 1
    keep = many[inv]
    col = (np.cumsum(many) - 1)[inv[keep]]
    row = row[keep]
    out = np.zeros((m, m), np.float64)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = max(256, 2_000_000 // max(m, 1))
    for lo in range(0, int(many.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x @ x.T
    return out


def join(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 0.999, block: int = 400) -> DataFrame:
    """doc_id, class_id (least doc_id of the component of similar documents), links (documents similar to it)."""
    spark = docs.sparkSession
    prof = stage(profiles(docs, k, similarity, recall), "profiles")
    classes = stage(prof.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"), F.first("less").alias("less")), "classes")
    loose = components(similar_forest(classes, similarity))
    members = stage(loose.join(classes.select("id", "k1", "copies"), "id").select("id", "k1", F.col("label").alias("comp"), "copies"), "members")
    shared = spark.sparkContext.broadcast(Bitmap.build(members.select(F.xxhash64("id").alias("h")), "h", 24))

    def may(batches):
        for b in batches:
            ok = pa.array(shared.value.has(np.asarray(b.column(2)).astype(np.int64).view(U64)))
            ids, text = b.column(0).filter(ok), b.column(1).filter(ok)
            k1 = [int(signed(set_hashes(s)[0].sum(keepdims=True))[0]) for s in shingle_sets(text, k)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(k1, pa.int64()), text], names=["id", "k1", "text"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).where("id is not null").mapInArrow(may, "id long, k1 long, text string")
    texts = texts.join(members.hint("merge"), ["id", "k1"]).groupBy("id", "k1").agg(F.first("comp").alias("comp"), F.first("copies").alias("copies"), F.min("text").alias("text"))
    dealt = blocks_of(stage(texts.select("comp", "id", "copies", "text"), "member-texts"), "comp", block)

    def verify(held):
        sets = list(shingle_sets(pa.array([r[3] for r in held], pa.string()), k))
        ids, copies, blk = [r[1] for r in held], np.array([r[2] for r in held]), np.array([r[6] for r in held])
        inter = jaccard_matrix(sets)
        n = np.array([len(s) for s in sets])
        union = n[:, None] + n[None, :] - inter
        link = inter >= similarity * union - 1e-9
        np.fill_diagonal(link, False)
        if held[0][4] != held[0][5]:
            link &= blk[:, None] != blk[None, :]
        total = link @ copies
        i, j = np.nonzero(np.triu(link))
        up = dict(forest(i, j, ids))
        return [(a, int(t), up.get(a, a)) for a, t in zip(ids, total)]

    found = stage(grouped(dealt, ["comp", "bi", "bj"], verify, "id long, links long, up long"), "links")
    label = components(found.where("id <> up").select(F.col("id").alias("a"), F.col("up").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    verdict = classes.select("k1", "k2", "id", "copies").join(links, "id", "left").join(label, "id", "left").select(
        "k1", "k2", F.coalesce("label", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = prof.select("doc_id", "k1", "k2").join(verdict.hint("merge"), ["k1", "k2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    return docs.select("doc_id").join(known.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def op6_jaccard(spark, sf_dir):
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
