"""Removal of repeated spans by De Bruijn compaction.

Windows of `k` words are the edges of a De Bruijn graph whose nodes are windows of k - 1 words; an edge is named by its
two nodes (128 bits). An edge repeats if its window starts in documents of differing ids.

1. Whole copies: a row whose whole text, by SHA-256, a smaller document has repeats throughout, and needs no edges.
2. Sieve: every window is represented by the least hash of its five-word parts, which equal windows share; a document
   gives each of these once (about one for five windows). Those that differing ids have pass into a bounded bitmap.
3. Edges: windows under a repeated part, each with the row and place where it starts. Summed by name, a repeated edge's
   source is its first place: least document, then least row key and position.
4. Compaction: a node with two repeated edges into it, or out of it, branches. Edges that follow each other at the source
   are one piece up to the next branching node; pieces of differing sources that meet in a node that does not branch are
   joined on it, and what hangs together so is one path. All of this is joins and sums over the distinct repeated edges.
5. Spans: the edges of a row that follow each other along a piece, whose source is another, smaller document.
6. Verification: the words of every span are digested at the source coordinates, from the source's own text, and a span is
   removed only where the row's words have the same digest. So equal names of differing windows remove nothing.

Rows are told apart by id and text: rows of one id with differing texts are judged each on its own, and are no repeats of
each other. Defined cases: null and empty texts have no words; repeated rows (one id, one text) get one result each, all
alike; rows with a null id are returned whole and are no source; ties on the least document go to the least position; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, Sieve, U64, discard, in_bitmap, mix, partitions_for, range_hashes, row_of, signed, small_batches, spans, stage, table, text_buffer, window_hashes
from tidemark.llm.components import chains

PART = 5
ROW = ("doc_id", "key")
SOURCE = ("src", "src_key")


def windows(buf, offs, k: int):
    """(row of each window, its first word, least part hash, word hashes, first word of each row)."""
    starts, ends, first = spans(buf, offs)
    words = range_hashes(buf, starts, ends)
    part = min(PART, k)
    g = window_hashes(words, part)
    rows = row_of(first, len(words))
    n = len(words) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), words, first
    low, span, width = g, 1, k - part + 1
    while 2 * span <= width:  # least over a growing run of parts
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = np.flatnonzero(rows[:n] == rows[k - 1 : k - 1 + n])
    return rows[at], at, mix(low[at]), words, first


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, t: a row is named by its id and a hash of its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("t"))


def whole_copies(rows: DataFrame) -> DataFrame:
    """doc_id, key of every row whose whole text a smaller document has."""
    d = rows.select(*ROW, F.unhex(F.sha2("t", 256)).alias("sha"))
    first = stage(d.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("sha", "least"), "copy-sources")
    return d.join(first.hint("merge"), "sha").where("doc_id <> least").select(*ROW).distinct()


def edges(rows: DataFrame, k: int) -> DataFrame:
    """l, r, doc_id, key, start of every window that may repeat, l and r its nodes. rows: doc_id, key, t."""
    spark = rows.sparkSession
    sieve = Sieve(spark)

    def owned(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                buf, offs = text_buffer(b.column(2).slice(lo, 250))
                ids = np.asarray(b.column(0).slice(lo, 250))
                rows, _, low, _, _ = windows(buf, offs, k)
                if len(low):
                    new = np.concatenate(([True], (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])))
                    yield low[new], ids[rows[new]], np.ones(int(new.sum()), bool)

    shared = spark.sparkContext.broadcast(sieve.bitmap(rows.mapInArrow(lambda batches: sieve.pack(owned(batches)), Sieve.FORM)))

    def named(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                buf, offs = text_buffer(b.column(2).slice(lo, 250))
                ids, keys = (np.asarray(b.column(i).slice(lo, 250)) for i in (0, 1))
                rows, at, low, words, first = windows(buf, offs, k)
                ok = shared.value.has(low)
                rows, at = rows[ok], at[ok]
                nodes = signed(window_hashes(words, k - 1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[at + 1]), pa.array(ids[rows]), pa.array(keys[rows]), pa.array((at - first[rows]).astype(np.int32))],
                                                 names=["l", "r", *ROW, "start"])

    return rows.mapInArrow(named, "l long, r long, doc_id long, key long, start int")


def sources(found: DataFrame) -> DataFrame:
    """l, r and source coordinates (src, src_key, src_at) of every distinct edge that repeats."""
    s = found.groupBy("l", "r").agg(F.max("doc_id").alias("most"), F.min(F.struct(*ROW, "start")).alias("s")).where("s.doc_id <> most")
    return s.select("l", "r", F.col("s.doc_id").alias("src"), F.col("s.key").alias("src_key"), F.col("s.start").alias("src_at"))


def branching(edge: DataFrame) -> DataFrame:
    """v: the nodes with two distinct edges into them, or out of them."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("l").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("r").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o > 1 or i > 1").select("v")


def pieces(edge: DataFrame, branch: DataFrame) -> DataFrame:
    """edge with `piece`, its piece's first edge, and whether its right node is `shut` (branches)."""
    marked = edge.join(branch.select(F.col("v").alias("r"), F.lit(True).alias("shut")).hint("merge"), "r", "left").withColumn("shut", F.coalesce("shut", F.lit(False)))
    w = Window.partitionBy(*SOURCE).orderBy("src_at")
    follows = (F.col("src_at") - F.lag("src_at").over(w) == 1) & ~F.lag("shut").over(w)
    head = F.when(~F.coalesce(follows, F.lit(False)), F.struct("l", "r"))
    return marked.withColumn("head", head).withColumn("piece", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("head")


def paths(piece: DataFrame) -> DataFrame:
    """piece, path (its first piece) of the pieces that are joined with others at nodes that do not branch."""
    ends = piece.groupBy("piece").agg(F.max(F.struct("src_at", "r", "shut")).alias("e"))
    tails = ends.where("not e.shut").select(F.col("e.r").alias("v"), F.col("piece").alias("a"))
    heads = piece.select("piece").distinct().select(F.col("piece.l").alias("v"), F.col("piece").alias("b"))
    return chains(stage(tails.join(heads.hint("merge"), "v").where("a <> b").select("a", "b"), "piece-links")).select(F.col("id").alias("piece"), F.col("label").alias("path"))


def repeats_of(found: DataFrame, edge: DataFrame) -> DataFrame:
    """doc_id, key, start, src, src_key, src_at, piece: a row's edges whose source is a smaller document."""
    return found.join(edge.hint("merge"), ["l", "r"]).where("doc_id > src").select(*ROW, "start", *SOURCE, "src_at", "piece")


def spans_of(hit: DataFrame) -> DataFrame:
    """doc_id, key, at, n (edges), src, src_key, src_at, piece: runs of a row's repeats along a piece."""
    w = Window.partitionBy(*ROW).orderBy("start")
    was = lambda c: F.lag(c).over(w)
    hit = hit.withColumn("again", F.coalesce(F.col("start") == was("start"), F.lit(False))).where("not again")  # repeated rows
    follows = (F.col("start") - was("start") == 1) & (F.col("src_at") - was("src_at") == 1) & (F.col("piece") == was("piece"))
    run = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    one = [F.first(c).alias(c) for c in (*SOURCE, "piece")]
    return hit.withColumn("run", run).groupBy(*ROW, "run").agg(F.min("start").alias("at"), F.count(F.lit(1)).cast("int").alias("n"), F.min("src_at").alias("src_at"), *one).select(*ROW, "at", "n", *SOURCE, "src_at", "piece")


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def verified(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """src, src_key, src_at, n, digest: the words at the source coordinates asked for, digested from the sources' texts."""
    spark = rows.sparkSession
    asked = stage(asked.select(*SOURCE, "src_at", "n").distinct(), "span-sources")
    is_source = in_bitmap(spark, Bitmap.build(asked.select(F.xxhash64(*SOURCE).alias("h")), "h", 24))
    texts = rows.where(is_source(F.xxhash64(*ROW))).select(F.col("doc_id").alias("src"), F.col("key").alias("src_key"), F.lit(-1).alias("src_at"), F.lit(0).alias("n"), "t")
    both = texts.unionByName(asked.withColumn("t", F.lit(None).cast("string"))).repartition(partitions_for(spark), *SOURCE).sortWithinPartitions(*SOURCE, "src_at", "n")

    def run(batches):
        now, words = None, []
        for b in batches:
            out = []
            for src, key, at, n, t in zip(*(c.to_pylist() for c in b.columns)):
                if at < 0:
                    if (src, key) != now:
                        now, words = (src, key), t.encode().split()
                elif (src, key) == now:
                    out.append((src, key, at, n, digest(words[at : at + n])))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*SOURCE, "src_at", "n", "digest"])

    return both.mapInArrow(run, "src long, src_key long, src_at int, n int, digest binary")


SPAN = "array<struct<at:int,n:int,digest:binary,path:struct<l:bigint,r:bigint>>>"


def repeated_spans(rows: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, key, spans: (first word, length in words, digest of the source's words, path) of a row's repeats of smaller
    documents; null for a row that repeats as a whole."""
    spark = rows.sparkSession
    small_batches(spark, 1000)
    rows = rows.where("doc_id is not null and t is not null")
    late = stage(whole_copies(rows), "whole-copies")
    is_late = in_bitmap(spark, Bitmap.build(late.select(F.xxhash64(*ROW).alias("h")), "h", 24))
    marked = rows.withColumn("late", is_late(F.xxhash64(*ROW)))
    own = marked.where("not late").drop("late").unionByName(marked.where("late").drop("late").join(late.hint("merge"), list(ROW), "left_anti"))
    found = stage(edges(own, k), "edges")
    distinct = stage(sources(found), "edge-sources")
    branch = stage(branching(distinct), "branching")
    edge = stage(pieces(distinct, branch), "edge-pieces")
    discard(distinct, branch)
    path = paths(edge)
    hit = stage(repeats_of(found, edge), "edge-repeats")
    discard(found, edge)
    span = stage(spans_of(hit).withColumn("n", F.col("n") + (k - 1)), "spans-found")
    discard(hit)
    seen = stage(verified(rows, span), "span-digests")
    known = span.join(seen.hint("merge"), [*SOURCE, "src_at", "n"]).join(path.hint("merge"), "piece", "left")
    one = F.struct("at", "n", "digest", F.coalesce("path", "piece").alias("path"))
    listed = known.groupBy(*ROW).agg(F.sort_array(F.collect_list(one)).cast(SPAN).alias("spans"))
    return listed.unionByName(late.select(*ROW, F.lit(None).cast(SPAN).alias("spans")))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans int, n_paths int"


def remove_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and its numbers of repeated spans (one for a whole copy) and of
    the paths they lie on."""
    if k < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    rows = rows_of(docs)
    gone = stage(repeated_spans(rows, k), "spans")
    loses = in_bitmap(spark, Bitmap.build(gone.select(F.xxhash64(*ROW).alias("h")), "h", 24))
    marked = rows.withColumn("hit", F.col("doc_id").isNotNull() & loses(F.xxhash64(*ROW)))

    def apply(b):
        out = []
        for i, text in enumerate(b.column(1)):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            total, cut, ways, n = len(words), 0, set(), 0
            if b.num_columns == 4 and b.column(2)[i].is_valid:
                given = b.column(3)[i].as_py()
                if given is None:
                    keep, n = (range(total), 0) if total < k else ((), 1)
                else:
                    lost = np.zeros(total + 1, np.int32)
                    for s in given:
                        if digest(words[s["at"] : s["at"] + s["n"]]) == s["digest"]:
                            lost[s["at"]] += 1
                            lost[s["at"] + s["n"]] -= 1
                            ways.add((s["path"]["l"], s["path"]["r"]))
                            n += 1
                    keep = np.flatnonzero(np.cumsum(lost)[:-1] == 0).tolist()
                cut = total - len(keep)
                words = [words[j] for j in keep]
            out.append((total, cut, hashlib.sha256(b" ".join(words)).hexdigest(), n, len(ways)))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[x.split()[0] for x in OUT.split(", ")])

    def finish(batches):
        for b in batches:
            yield apply(b)

    plain = marked.where("not hit").select("doc_id", "t").mapInArrow(finish, OUT)
    moved = marked.where("hit").select(*ROW, "t").join(gone.withColumn("found", F.lit(True)).hint("merge"), list(ROW), "left").select("doc_id", "t", "found", "spans")
    return plain.unionByName(moved.mapInArrow(finish, OUT))


OP10_SQL = r"""
with w as (
  select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words from documents),
p as (select doc_id, generate_subscripts(words, 1) as i, unnest(words) as word from w),
t as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w),
g as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as s from t),
f as (select s, min(doc_id) as first from g group by s),
gone as (select distinct doc_id, i from (select g.doc_id, unnest(range(g.i, g.i + 13)) as i from g join f using (s) where g.doc_id > f.first)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as k from p anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def op10_substring(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
