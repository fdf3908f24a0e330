"""Near-duplicate lines by a segment-partition edit join.

Lines are normalised (ASCII lower case, white space collapsed) and compared by `unit`: UTF-8 bytes, or characters
(code points), as op9 and the pipeline do. A line of `least` bytes or more is split into edits + 1 segments; two lines within `edits` edits share a segment of one at a place near that in the
other, so each line is indexed by (length, segment, hash) and probes the indexes of its own and the `edits` shorter
lengths. A sieve drops keys that only copies of one line hold; for the others the lines meet, and pairs are verified by a
bit-parallel edit distance whose band (2 x edits + 1 diagonals) lies in one machine word, over many pairs at once.

A line goes if an equal or close line comes earlier, by (doc_id, line number); shorter lines only if an equal one
does. Blank lines stay. Within a key only the verdict of each line leaves the task, never its pairs; lines are tried
against the earliest first, so a group of many close lines takes about one comparison a line, and a key of many lines is
dealt as pairs of blocks.

Defined cases: null texts have no lines and stay null; empty texts stay empty; repeated rows (one doc_id twice) are
one document; an empty table gives no rows; other columns are kept, but for those named as the three this adds, whose names
are a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, WHITE, Bitmap, Sieve, U64, discard, in_bitmap, mix, partitions_for, powers, range_hashes, row_of, signed, small_batches, spans, stage, table, text_buffer


NORMAL = np.where(WHITE, np.uint8(32), LOWER)


def lines_of(buf: np.ndarray, offs: np.ndarray):
    """(normalised bytes, starts, ends, row and number of each line that is not blank)."""
    starts, ends, first = spans(buf, offs)
    z = np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint8), z, z, z, z
    rows, feeds, out = row_of(first, len(starts)), np.flatnonzero(buf == 10), NORMAL[buf]
    line = np.searchsorted(feeds, starts)
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])))
    wide = np.where(new, 0, starts - np.concatenate(([0], ends[:-1])) - 1)  # white space beyond one before a word
    if (wide > 0).any():
        w = np.flatnonzero(wide > 0)
        gone = np.zeros(len(buf) + 1, np.int32)
        np.add.at(gone, starts[w] - wide[w], 1)
        np.add.at(gone, starts[w], -1)
        out, shift = out[np.cumsum(gone)[:-1] == 0], np.cumsum(wide)
        starts, ends = starts - shift, ends - shift
    at = np.flatnonzero(new)
    row = rows[at]
    return out, starts[at], ends[np.append(at[1:], len(starts)) - 1], row, line[at] - np.searchsorted(feeds, offs[row])


_OTHER = (np.arange(256) * 167 + 13).astype(np.uint8)


def names(buf, starts, ends):
    """128 bits that name each line."""
    return range_hashes(buf, starts, ends), range_hashes(_OTHER[buf], starts, ends)


def points(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(characters, starts, ends) of lines given as UTF-8 bytes: one number for each code point, an ASCII byte its own.
    Malformed bytes count as characters of up to four bytes; the same bytes of a line always give the same numbers."""
    tail = np.flatnonzero((buf & 0xC0) == 0x80)  # only these few bytes are looked at one by one
    begins = np.zeros(len(buf) + 1, bool)
    begins[starts], begins[0] = True, True
    tail = tail[~begins[tail]]
    if not len(tail):
        return buf, starts, ends
    new = np.concatenate(([True], np.diff(tail) != 1))
    nth = np.arange(len(tail)) - np.maximum.accumulate(np.where(new, np.arange(len(tail)), 0))
    tail, nth = tail[nth < 3], nth[nth < 3]  # a fourth continuation in a row begins a character
    lead = np.ones(len(buf), bool)
    lead[tail] = False
    value = buf[lead].astype(np.uint32)
    own = tail - np.arange(len(tail)) - 1  # the character that a continuation belongs to
    for j in range(3):
        at = own[nth == j]
        value[at] = (value[at] & 0x3FFFFFF) << 6 | buf[tail[nth == j]] & 63 | np.uint32((j + 1) << 26)
    return value, starts - np.searchsorted(tail, starts), ends - np.searchsorted(tail, ends)


def characters(lines: list) -> list[np.ndarray]:
    """The characters of each line; lines that are already so stay."""
    if all(not isinstance(x, bytes) for x in lines):
        return lines
    if all(x.isascii() for x in lines):
        return [np.frombuffer(x, np.uint8) for x in lines]
    ends = np.cumsum([len(x) for x in lines])
    full = np.array([len(x) > 0 for x in lines])
    starts = ends - [len(x) for x in lines]
    value, first, _ = points(np.frombuffer(b"".join(lines), np.uint8), starts[full], ends[full])
    cut = np.append(first, len(value))
    got = iter([value[i:j] for i, j in zip(cut, cut[1:])])
    return [next(got) if f else value[:0] for f in full]


def octets(lines: list) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in lines]


UNITS = {"byte": octets, "character": characters}


def within(a: list, b: list, k: int) -> np.ndarray:
    """Which pairs are within k edits of characters. Pairs whose lengths differ too much are out at once; equal beginnings
    and ends are cut off; the rest goes through the band."""
    out = np.zeros(len(a), bool)
    a, b = characters(a), characters(b)
    rest, x, y = [], [], []
    for i, (u, v) in enumerate(zip(a, b)):
        if abs(len(u) - len(v)) <= k:
            m = min(len(u), len(v))
            d = np.flatnonzero(u[:m] != v[:m])
            lo = int(d[0]) if len(d) else m
            e = np.flatnonzero(u[len(u) - m + lo :] != v[len(v) - m + lo :])
            cut = m - lo - 1 - int(e[-1]) if len(e) else m - lo
            p, q = u[lo : len(u) - cut], v[lo : len(v) - cut]
            if len(p) <= k and len(q) <= k:
                out[i] = True
            else:
                rest.append(i)
                x.append(p)
                y.append(q)
    order = sorted(range(len(rest)), key=lambda i: len(x[i]))
    for s in range(0, len(order), 1024):
        part = order[s : s + 1024]
        p, q = [x[i] for i in part], [y[i] for i in part]
        out[[rest[i] for i in part]] = _band(p, q, np.array([len(v) for v in p]), np.array([len(v) for v in q]), k)
    return out


def _codes(x: list[np.ndarray], width: int, left: int, fill: int) -> np.ndarray:
    m = np.full((len(x), width), fill, np.int16 if all(s.dtype == np.uint8 for s in x) else np.int32)
    for r, s in enumerate(x):
        m[r, left : left + len(s)] = s
    return np.ascontiguousarray(m.T)


def _band(a, b, la, lb, k) -> np.ndarray:
    n, w = len(a), 2 * k + 1
    top = int(max(la.max(), lb.max()))
    A = _codes(a, top + 2 * k + 2, k, -1)  # A[j + d] is character j - k + d of a
    B = _codes(b, top + 1, 0, -2)
    full = np.int64((1 << w) - 1)
    # R[e]: bit d set if diagonal d reaches the current column with at most e edits (the automaton of Wu and Manber)
    R = [np.zeros(n, np.int64) for _ in range(k + 1)]
    for e in range(k + 1):
        for d in range(k, min(w - 1, k + e) + 1):  # column 0: row d - k costs d - k insertions
            R[e] |= np.int64(1 << d)
    for j in range(top):
        act = j < lb
        if not act.any():
            break
        eq = np.zeros(n, np.int64)
        for d in range(w):
            eq |= (A[j + d] == B[j]).astype(np.int64) << d
        new = []
        for e in range(k + 1):
            x = R[e] & eq  # diagonal move over equal characters
            if e:
                x |= R[e - 1]  # substitution: same diagonal
                x |= R[e - 1] >> 1  # a character of b more: one diagonal lower
                x |= (new[e - 1] << 1) & full  # a character of a more, in this column
            new.append(x)
        R = [np.where(act, x, r) for x, r in zip(new, R)]
    d = la - lb + k
    return ((R[k] >> d) & 1).astype(bool)


_CODE = mix(np.arange(1, 257, dtype=U64))


class Keys:
    """Index and probe keys of lines."""

    def __init__(self, edits: int, unit: str = "byte"):
        self.k, self.unit = edits, unit

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(line, key, whether it is an index key), by prefix sums over the units of lines given as bytes."""
        if self.unit == "character":
            buf, starts, ends = points(buf, starts, ends)
        k, rows, keys, kinds, lo = self.k, [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, bool)], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 18), "right")))
            base0 = int(starts[lo])
            pw, inv = powers(int(ends[hi - 1]) - base0 + 1)
            part = buf[base0 : int(ends[hi - 1])]
            code = _CODE[part & 255]
            if part.dtype != np.uint8:
                big = part > 255
                code[big] = mix(part[big].astype(U64) + U64(1))
            sums = np.concatenate(([U64(0)], np.cumsum(code * pw[: len(code)])))
            begin, L, row = starts[lo:hi] - base0, ends[lo:hi] - starts[lo:hi], np.arange(lo, hi)
            for short in range(k + 1):  # the indexed line has length L - short
                length = L - short
                for seg in range(k + 1):
                    size = length // (k + 1) + (seg >= k + 1 - length % (k + 1))
                    base = seg * (length // (k + 1)) + np.maximum(0, seg - (k + 1 - length % (k + 1)))
                    for d in range(max(-seg, short - (k - seg)), min(seg, short + (k - seg)) + 1):
                        at = base + d
                        ok = np.flatnonzero((at >= 0) & (at + size <= L) & (length > k))
                        s = begin[ok] + at[ok]
                        h = (sums[s + size[ok]] - sums[s]) * inv[s]
                        keys.append(mix(mix(h) + length[ok].astype(U64) * U64(8 * 0x9E3779B1) + U64(seg * 0x85EBCA6B + 7)))
                        rows.append(row[ok])
                        kinds.append(np.full(len(ok), short == 0 and d == 0))
            lo = hi
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(kinds)


def all_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, n of every line that is not blank."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                buf, offs = text_buffer(b.column(1).slice(lo, 250))
                out, starts, ends, row, n = lines_of(buf, offs)
                h1, h2 = names(out, starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), b.column(0).slice(lo, 250).take(pa.array(row)), pa.array(n.astype(np.int32))], names=["h1", "h2", "doc_id", "n"])

    return docs.mapInArrow(run, f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int")


def long_lines(b, least: int):
    """By pieces of a batch: buffer, starts, ends and hashes of the distinct lines of `least` bytes or more."""
    for lo in range(0, b.num_rows, 250):
        buf, offs = text_buffer(b.column(1).slice(lo, 250))
        out, starts, ends, *_ = lines_of(buf, offs)
        ok = ends - starts >= least
        starts, ends = starts[ok], ends[ok]
        h1 = range_hashes(out, starts, ends)
        _, keep = np.unique(h1, return_index=True)
        keep.sort()
        yield out, starts[keep], ends[keep], h1[keep]


def earlier_lines(docs: DataFrame, edits: int = 2, least: int = 24, block: int = 2000, unit: str = "byte") -> DataFrame:
    """(doc_id, n) of all lines that have an equal or close line before them."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("t")).where("doc_id is not null and t is not null")
    lines = stage(all_lines(docs), "lines")
    firsts = stage(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.count(F.lit(1)).alias("places")), "line-firsts")
    keyer, sieve, read = Keys(edits, unit), Sieve(spark), UNITS[unit]

    def owned(batches):
        for b in batches:
            for buf, starts, ends, h1 in long_lines(b, least):
                rows, keys, kinds = keyer.of(buf, starts, ends)
                yield keys, signed(h1)[rows], kinds

    shared = spark.sparkContext.broadcast(sieve.bitmap(docs.mapInArrow(lambda batches: sieve.pack(owned(batches)), Sieve.FORM)))

    def bring(batches):
        """The lines under the keys that may be live, each distinct line once for a piece."""
        for b in batches:
            for buf, starts, ends, h1 in long_lines(b, least):
                rows, keys, kinds = keyer.of(buf, starts, ends)
                ok = shared.value.has(keys)
                rows, keys, kinds = rows[ok], keys[ok], kinds[ok]
                some = np.unique(rows)
                h2 = range_hashes(_OTHER[buf], starts[some], ends[some])[np.searchsorted(some, rows)]
                raw = buf.tobytes()
                text = pa.array([raw[a:z] for a, z in zip(starts[rows].tolist(), ends[rows].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(kinds), pa.array(signed(h1[rows])), pa.array(signed(h2)), text], names=["key", "own", "h1", "h2", "t"])

    met = docs.mapInArrow(bring, "key long, own boolean, h1 long, h2 long, t binary")
    # Copies of one line under a key become one row, and then get the line's first place.
    met = met.groupBy("key", "h1", "h2").agg(F.bool_or("own").alias("own"), F.first("t").alias("t"))
    met = stage(met.join(firsts.hint("merge"), ["h1", "h2"]).select("key", "own", "h1", "h2", "f.doc_id", "f.n", "t"), "line-met")
    # A key of many lines is dealt as pairs of blocks, so no task holds more than two blocks of it.
    large = met.groupBy("key").count().where(F.col("count") > 2 * block).select("key", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    mine = F.pmod(F.col("h1"), F.col("nb")).cast("int")
    pairs = F.when(F.col("nb").isNull(), F.array(F.lit("0"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.concat_ws(",", F.least(o, mine), F.greatest(o, mine))))
    dealt = met.join(large.hint("merge"), "key", "left").withColumn("pair", F.explode(pairs)).select("key", "own", "h1", "h2", "doc_id", "n", "t", "pair")
    dealt = dealt.repartition(partitions_for(spark), "key", "pair").sortWithinPartitions("key", "pair", "doc_id", "n")

    def verify(batches):
        now, held, small, out = None, [], [], []

        def close():
            if len(held) < 2 or not any(r[1] for r in held):
                return
            if len(held) <= 12:  # pairs of small groups wait for company
                for i in range(1, len(held)):
                    small.extend((held[i], held[j]) for j in range(i) if held[i][1] or held[j][1])
                if len(small) > 20_000:
                    flush()
            else:
                out.extend(late(held, edits, read))

        def flush():
            if small:
                a, b = read([p[6] for p, _ in small]), read([q[6] for _, q in small])
                some = np.flatnonzero(likely(a, b, edits))
                good = some[within([a[i] for i in some], [b[i] for i in some], edits)]
                out.extend({(small[i][0][2], small[i][0][3]) for i in good})
                small.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if (r[0], r[7]) != now:
                    close()
                    now, held = (r[0], r[7]), []
                held.append(r)
            yield pack(out)
            out.clear()
        close()
        flush()
        yield pack(out)

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["h1", "h2"])

    close_ones = dealt.mapInArrow(verify, "h1 long, h2 long").distinct().withColumn("close", F.lit(True))
    # All places of a line with a close one before its first place; else its places after the first.
    flagged = stage(firsts.join(close_ones.hint("merge"), ["h1", "h2"], "left").where("close or places > 1").select("h1", "h2", "f", "close"), "line-late")
    discard(met, firsts)
    return lines.join(flagged.hint("merge"), ["h1", "h2"]).where("close or struct(doc_id, n) <> f").select("doc_id", "n")


def counts(x: list) -> np.ndarray:
    out = np.zeros((len(x), 64), np.int32)
    for r, s in enumerate(characters(x)):
        out[r] = np.bincount(s & 63, minlength=64)
    return out


def likely(a: list[bytes], b: list[bytes], k: int) -> np.ndarray:
    """Pairs whose counts of characters differ by no more than k edits could make them."""
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 4096):
        out[s : s + 4096] = np.abs(counts(a[s : s + 4096]) - counts(b[s : s + 4096])).sum(1) <= 2 * k
    return out


def late(group, k: int, read=octets):
    """Names (h1, h2) of the lines of a key, sorted by first place, with a close line before them. Block by block
    against the earliest lines first; a line found late is not tried again, but others are tried against it."""
    text, own = read([r[6] for r in group]), np.array([r[1] for r in group])
    have = counts(text)
    open_, found = np.arange(1, len(group)), np.zeros(len(group), bool)
    step, lo = 1, 0
    while len(open_) and lo < len(group):
        hi = min(len(group), lo + step)
        width = max(1, 100_000 // (hi - lo))
        for c in range(0, len(open_), width):
            part = open_[c : c + width]
            i, j = np.repeat(part, hi - lo), np.tile(np.arange(lo, hi), len(part))
            ok = (j < i) & (own[i] | own[j])
            i, j = i[ok], j[ok]
            ok = np.abs(have[i] - have[j]).sum(1) <= 2 * k
            i, j = i[ok], j[ok]
            if len(i):
                found[i[within([text[x] for x in i], [text[x] for x in j], k)]] = True
        open_ = open_[~found[open_] & (open_ > lo)]
        lo, step = hi, min(64, step * 4)
    return [(group[i][2], group[i][3]) for i in np.flatnonzero(found)]


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 24, unit: str = "byte", names=("removed", "n_lines", "n_removed")) -> DataFrame:
    """docs with `text` without its late lines, and by `names` the numbers of these (in order), of all lines, and of those
    removed."""
    spark = docs.sparkSession
    gone = stage(earlier_lines(docs, edits, least, unit=unit).groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("__gone")), "line-gone")
    base = docs.drop(*[c for c in docs.columns if c in names])
    # Only texts that lose lines move: others pass a bounded filter on their ids and are emitted where they are read.
    loses = in_bitmap(spark, Bitmap.build(gone.select(F.xxhash64("doc_id").alias("h")), "h", 24))
    marked = base.withColumn("__hit", loses(F.xxhash64("doc_id")))
    cut = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("__gone"), s.i)), lambda s: s.x), "\n")
    total = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    hit = marked.where("__hit").drop("__hit").join(gone.hint("merge"), "doc_id", "left")
    rest = marked.where("not __hit").drop("__hit").withColumn("__gone", F.lit(None).cast("array<int>"))
    both = hit.select(*base.columns, "__gone").unionByName(rest)
    none = F.coalesce("__gone", F.array().cast("array<int>"))
    text = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cut).alias("text")
    added = (none.alias(names[0]), F.when(F.col("text").isNull(), 0).otherwise(total).alias(names[1]), F.size(none).alias(names[2]))
    return both.select(*[text if c == "text" else F.col(c) for c in base.columns], *added)


def op9_line_dedup(spark, sf_dir):
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="character")
    return got.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
