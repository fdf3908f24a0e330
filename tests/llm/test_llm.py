"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, exact, jaccard, language, lines, lm, packing, spans, toxicity, warc
from tidemark.llm.common import text_buffer

FORM = "doc_id long, text string, lang string, source string, n_chars long, removed string, class_id string"
random.seed(4)
WORDS = [f"w{i}x" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    shared = prose(40, 2)
    t = {0: base, 1: " ".join(near), 2: base.upper(), 3: None, 4: "", 5: " \n\t ", 6: prose(30, 3) + "\n" + shared + "\n" + prose(9, 4), 7: prose(8, 5) + " " + shared, 8: prose(5000, 6), 9: "one two", 10: "one two", 11: base, 12: "Ünïcode   text\n" + shared}
    rows = [(i, x, None if i == 9 else "ab"[i % 2], "s", len(x or ""), "clash", "clash") for i, x in t.items()]
    return rows + [rows[0], rows[9], (13, base + "\n" + "a line of some length that is here\nA LINE  of some length that is herE", "a", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), FORM).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def text_of():
    return {r[0]: r[1] or "" for r in corpus()}


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    ids = {i: np.asarray(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in text_of().items()}
    for limits in ({}, {"max_tokens": 64, "max_segments": 3, "max_loss": 50, "pool": 4}):
        rows = packing.pack(docs, vocabulary(), **limits).collect()
        seqs, pieces = collections.defaultdict(list), collections.Counter()
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
            seqs[r.sequence_id].append(r)
            pieces[r.doc_id] += r.length
        copies = collections.Counter(r[0] for r in corpus())
        assert pieces == {i: len(ids[i]) * n for i, n in copies.items()}
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == list(np.cumsum([0, *[r.length for r in s[:-1]]]))
            assert sum(r.length for r in s) <= limits.get("max_tokens", 2048) and len(s) <= limits.get("max_segments", 256) and sum(r.loss_tokens for r in s) <= limits.get("max_loss", 2048)
    assert packing.pack(empty, vocabulary()).count() == 0


def test_language(spark, docs, empty):
    a, b = "the of and to in that was for with this", "der die und das nicht ein mit auch sich von"
    r = random.Random(0)
    rows = [(i, " ".join(r.choice((a if i % 2 else b).split()) for _ in range(60)), "en" if i % 2 else "de", "s", 1, "", "") for i in range(200)]
    train, test = spark.createDataFrame(rows[:150], FORM), spark.createDataFrame(rows[150:], FORM)
    model = language.train(train)
    got = language.identify(test, model).collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.95 and all(0 <= x.score <= 1 for x in got)
    odd = {x.doc_id: x.lang_pred for x in language.identify(docs, model).collect()}
    assert odd[3] == odd[4] == odd[5] == "und"
    assert language.train(empty) is None and language.identify(empty, None).count() == 0
    assert {x.lang_pred for x in language.identify(docs, None).collect()} == {"und"}


def test_exact(docs, empty):
    low = str.maketrans(exact.UPPER, exact.LOWER)
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[(r[1] or "").translate(low)].append(r[0])
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for i in g)
    assert sorted(map(tuple, exact.dedup(docs).collect())) == want
    assert sorted(map(tuple, exact.dedup(docs, table_bytes=300, bucket_bytes=500).collect())) == want
    for parts in (1, 7):
        assert sorted(map(tuple, exact.dedup(docs.repartition(parts), table_bytes=300, bucket_bytes=500, hot=1).collect())) == want
    assert exact.dedup(empty).count() == 0


def test_grace_spills_and_streams_equal_hashes():
    rows = [(h, c, n, n, 1) for n, (h, c) in enumerate((i % 5, b"x%d" % (i % 50)) for i in range(2000))]
    got = {p: (top, n, first, c) for p, top, n, first, _, c in exact.Grace(4000).run(iter(rows))}
    for h, c, part, _, _ in rows:
        same = [r[2] for r in rows if r[0] == h and r[1] == c]
        first = got[part][2]
        assert got[part][:2] == (max(same), len(same)) and first in same and got[first][2:] == (first, c) and (part == first or got[part][3] is None)


def lm_brute(rows, target):
    """(id, tokens, score) of every row, by plain dictionaries, each row under the models of all others."""
    toks = [(i, re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))) for i, x in rows]
    uni, pair = ([collections.Counter(), collections.Counter()] for _ in range(2))
    for i, w in toks:
        s = 0 if i in target else 1
        uni[s].update(w)
        pair[s].update(zip(w, w[1:]))
    out = []
    for i, w in toks:
        mine = 0 if i in target else 1
        u, p2 = collections.Counter(w), collections.Counter(zip(w, w[1:]))
        one = lambda s, x: uni[s][x] - (u[x] if s == mine else 0)
        two = lambda s, v, x: pair[s][v, x] - (p2[v, x] if s == mine else 0)
        n = [sum(uni[s].values()) - (len(w) if s == mine else 0) for s in (0, 1)]
        got = 0.0
        for j, x in enumerate(w):
            if one(0, x) + one(1, x) < 1 or not all(n):
                continue
            p = []
            for s in (0, 1):
                k = n[0] / n[s]
                flat = 0.9 * one(s, x) * k / n[0] + 0.1 * (one(0, x) + one(1, x)) / sum(n)
                v = w[j - 1] if j else None
                if j and one(0, v) + one(1, v) > 0:
                    flat = (two(s, v, x) * k + 5 * flat) / (one(s, v) * k + 5)
                p.append(flat)
            got += math.log(p[1]) - math.log(p[0])
        out.append((i, len(w), got / max(len(w), 1)))
    return sorted(out)


@pytest.mark.parametrize("chunk,keys", [(16 << 20, 1 << 21), (400, 1 << 21), (300, 8)])
def test_lm(spark, docs, empty, chunk, keys, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "RANGE", keys)
    assert (lm.growth(10_000) > 1) == (keys == 8) and lm.growth(0) == 1
    monkeypatch.setattr(lm, "DOCS", 200 if chunk > 1000 else 2)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm.score(docs, docs.where("doc_id in (0, 1, 2, 11)").unionByName(docs.where("doc_id = 1"))).collect())
    want = lm_brute([(r[0], r[1]) for r in corpus()], {0, 1, 2, 11})
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-8)
    by = {i: s for i, _, s in got}
    assert by[3] == by[4] == 0 and by[0] < 0 < by[8]


def test_lm_one_sided(docs, empty):
    assert {r.score for r in lm.score(docs, empty).collect()} == {0.0}
    assert lm.score(empty, empty).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    rows = [(i, prose(40, i) + (" you " + r.choice(["vile1", "scumword", "V1LE1"]) + " " + prose(9, -i) if i % 4 == 0 else ""), "a", "s", 1, "", "") for i in range(600)]
    d = spark.createDataFrame(rows, FORM)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(labels, d)
    got = [x for x in toxicity.score(d, model).collect() if x.doc_id >= 400]
    assert np.mean([(x.doc_id % 4 == 0) == bool(x.predicted) for x in got]) > 0.95 and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, None).count() == 0
    assert toxicity.train(labels.where("toxic = 0"), d) is None


def shingles(x):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    w = x.encode().translate(low).split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [400, 2])
def test_jaccard(spark, docs, empty, block):
    rows = [r for n, r in enumerate(corpus()) if n < 13]
    fam = prose(200, 50).split()
    for k in range(12):
        w = list(fam)
        w[k * 11] = f"z{k}"
        rows.append((100 + k, " ".join(w), "a", "s", 1, "", ""))
    s = {r[0]: shingles(r[1] or "") for r in rows}
    near = {(a, b) for a in s for b in s if a != b and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    label = {a: a for a in s}
    for _ in s:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.join(spark.createDataFrame(rows, FORM).select("doc_id", "text"), block=block).collect()}
    assert got == {a: (label[a], sum(x == a for x, _ in near)) for a in s}
    assert jaccard.join(empty.select("doc_id", "text")).count() == 0


def similar_pairs(n, r):
    """n pairs of sets of 180 shingles with 160 in common: a similarity of 0.8."""
    for _ in range(n):
        u = np.array([r.getrandbits(64) for _ in range(200)], np.uint64)
        yield np.sort(u[:180]), np.sort(np.concatenate((u[:160], u[180:])))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_jaccard_recall_at_the_threshold(levels):
    """Pairs at similarity 0.8 whose paths are split at every level: found in one run at least, at each depth allowed."""
    r, found, total, similarity = random.Random(levels), 0, 400, 0.8
    start = jaccard.mix(np.arange(jaccard.runs_for(0.999), dtype=np.uint64) + np.uint64(1))
    for a, b in similar_pairs(total, r):
        x, y = jaccard.embed(a), jaccard.embed(b)
        both = [np.unique(jaccard.follow(jaccard.mix(v + jaccard._SLOT), start, similarity)[1]) for v in (x, y)]
        paths = np.intersect1d(*both)
        for _ in range(levels - 1):
            both = [np.unique(jaccard.follow(jaccard.tokens(jaccard.short(v).tobytes()), paths, similarity)[1]) if len(paths) else paths for v in (x, y)]
            paths = np.intersect1d(*both)
        found += len(paths) > 0
    assert levels <= jaccard.DEPTH and found >= 0.985 * total


def test_jaccard_of_few_shingles_is_exact(spark):
    """8 words against 9: similarity 4 / 5 exactly."""
    rows, want = [], {}
    for n in range(60):
        w = [f"s{n}w{i}" for i in range(9 + n % 4)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[:-1]))]
        want |= {2 * n: (2 * n, 1), 2 * n + 1: (2 * n, 1)}
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_jaccard_of_one_id_with_two_texts(spark):
    a, b = prose(60, 21), prose(60, 22)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(60, 23)), (None, a), (None, None)]
    got = collections.Counter((r.doc_id, r.class_id, r.links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 1, 2), (1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 0), (None, None, 0), (None, None, 0)])


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "x", "WARC/1.1\r\n\r\nboo" * 500)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, type string")
    path = f"file://{tmp_path}/w"
    warc.write(df, path)
    got = {int(bytes(r.metadata.payload).split(b"\r\n")[0].split()[1]): r for r in warc.assemble(warc.read(spark, path)).collect()}
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(i, top.get(h or "", 0))
    for i, _, h in pages:
        body, r = (h or "").encode(), got[i]
        assert r.request.type == "request" and r.response.digest_ok and r.response.payload_bytes == len(body)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if top[h or ""] == i:
            assert r.response.type == "response" and bytes(r.response.payload) == body
        else:
            assert r.response.type == "revisit" and r.response.refers_to == got[top[h or ""]].response.record_id
    warc.write(df.limit(0), path + "0")
    assert warc.assemble(warc.read(spark, path + "0")).count() == 0


def test_decontamination(spark, docs, empty):
    item = prose(30, 77)
    hit = item.split()
    hit[7] = hit[19] = "other"
    rows = [(200, prose(50, 8) + " " + item.upper() + ", " + prose(9, 9), *("x",) * 2, 1, "", ""), (201, prose(20, 10) + "; " + ". ".join(hit), *("x",) * 2, 1, "", ""), (202, prose(400, 11), *("x",) * 2, 1, "", "")]
    d = docs.unionByName(spark.createDataFrame(rows, FORM))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (5, prose(30, 78))], "item_id long, text string")
    for block in (1_000_000, 20):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(d, bench, block_tokens=block).collect()} == {(200, 1), (201, 1), (9, 4), (10, 4)}
    assert decontaminate.find_overlaps(empty, bench).count() == decontaminate.find_overlaps(d, bench.limit(0)).count() == 0


def substituted(n, changed, pad=("before", "after")):
    """A text of n words, and a copy for every placement of up to `changed` other words, padded."""
    item = [f"t{n}w{i}" for i in range(n)]
    copies = []
    for k in range(changed + 1):
        for at in itertools.combinations(range(n), k):
            copies.append(" ".join([pad[0], *("other" if i in at else x for i, x in enumerate(item)), pad[1]]))
    return " ".join(item), copies


def found_rows(copies, items, **limits):
    p = {"window": 13, "least": 10, "shortest": 8} | limits
    block = decontaminate.Items(list(range(len(items))), items, p["window"], p["least"], p["shortest"])
    buf, offs = text_buffer(pa.array(copies))
    starts, ends, first = decontaminate.spans(buf, offs, decontaminate.NON_WORD)
    return {x[:2] for x in decontaminate.overlaps(decontaminate.range_hashes(buf, starts, ends), first, block, p["least"], p["shortest"])}


def test_decontamination_finds_every_substitution_of_a_window():
    item, copies = substituted(13, 3)
    assert len(copies) == 1 + 13 + 78 + 286
    assert found_rows(copies, [item]) == {(r, 0) for r in range(len(copies))}
    far = " ".join(["x", *("other" if i in (0, 4, 8, 12) else x for i, x in enumerate(item.split()))])
    assert found_rows([far], [item]) == set()
    for window, least in ((13, 13), (13, 8), (17, 13), (20, 14), (8, 5)):
        item, copies = substituted(window, window - least)
        copies = copies[:: max(1, len(copies) // 500)]
        assert found_rows(copies, [item], window=window, least=least) == {(r, 0) for r in range(len(copies))}


def test_decontamination_finds_every_substitution_of_short_items():
    items, texts, want = [], [], set()
    for n, changed in ((1, 0), (2, 0), (7, 0), (8, 1), (9, 2), (10, 2), (11, 2), (12, 2), (13, 3)):
        item, copies = substituted(n, min(n, changed + 1))
        allowed = sum(math.comb(n, k) for k in range(changed + 1))
        want |= {(len(texts) + r, len(items)) for r in range(allowed)}
        items.append(item)
        texts += copies
        assert allowed < len(copies)
    assert found_rows(texts, items) == want
    assert found_rows([t.removeprefix("before ").removesuffix(" after") for t in texts], items) == want
    item, copies = substituted(12, 0)
    assert found_rows(copies, [item], least=13) == {(0, 0)}


def lev(a, b):
    p = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        q = [x]
        for z, cb in enumerate(b, 1):
            q.append(min(p[z] + 1, q[-1] + 1, p[z - 1] + (ca != cb)))
        p = q
    return p[-1]


def test_band_equals_edit_distance():
    r = random.Random(2)
    a, b = [], []
    for _ in range(800):
        x = bytes(r.choice(b"ab ") for _ in range(r.randint(0, 20)))
        y = bytearray(x)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = bytes(r.choice(b"abc") for _ in range(r.randint(0, 1)))
        a.append(x)
        b.append(bytes(y))
    for k in (1, 2, 3):
        want = np.array([lev(x, y) <= k for x, y in zip(a, b)])
        assert (lines.within(a, b, k) == want).all() and (lines.likely(a, b, k) >= want).all()


@pytest.mark.parametrize("block", [2000, 2])
def test_line_dedup(spark, docs, empty, block):
    r = random.Random(3)
    base = [prose(6, 900 + i) for i in range(6)]
    rows = []
    for i in range(60):
        x = []
        for _ in range(3):
            y = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                y[r.randrange(len(y))] = r.choice("qé ")
            x.append("".join(y))
        rows.append((i, "\n".join(x) + "\n\nshort\n  ", "a", "s", 1, "", ""))
    rows += [(300, None, *("a",) * 2, 1, "", ""), (301, "", *("a",) * 2, 1, "", "")]
    seen, want = [], collections.defaultdict(list)
    low = str.maketrans(exact.UPPER, exact.LOWER)
    for i, x, *_ in rows:
        for n, y in enumerate((x or "").split("\n")):
            y = b" ".join(y.translate(low).encode().split())
            if y:
                if any(y == z or (min(len(y), len(z)) >= 24 and abs(len(y) - len(z)) <= 2 and lev(y, z) <= 2) for z in seen):
                    want[i].append(n)
                seen.append(y)
    d = spark.createDataFrame(rows, FORM)
    assert {(x.doc_id, x.n) for x in lines.earlier_lines(d.select("doc_id", "text"), block=block).collect()} == {(i, n) for i, v in want.items() for n in v}
    got = {x.doc_id: x for x in lines.dedup_lines(d).collect()}
    assert got[300].text is None and got[301].text == ""
    for i, x, *_ in rows[:60]:
        assert got[i].text == "\n".join(y for n, y in enumerate(x.split("\n")) if n not in want[i]) and list(got[i].removed) == want[i]
    assert lines.dedup_lines(empty).count() == 0 and lines.dedup_lines(docs).count() == docs.count()


ALPHABET = "ab é\u4e2d\u0101\U0001f600"


def test_characters_equal_edit_distance_over_code_points():
    r = random.Random(5)
    a, b = [], []
    for _ in range(800):
        x = [r.choice(ALPHABET) for _ in range(r.randint(0, 20))]
        y = list(x)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = [r.choice(ALPHABET) for _ in range(r.randint(0, 1))]
        a.append("".join(x))
        b.append("".join(y))
    p, q = ([x.encode() for x in c] for c in (a, b))
    assert [[int(v) & 0x3FFFFFF for v in c] for c in lines.characters([x.encode() for x in "ab"])] == [[97], [98]]
    assert [len(c) for c in lines.characters(p)] == [len(x) for x in a]
    odd = [b"\x80\x80\x80\x80\x80\x80", b"a\x80", b"\xc3", b"\xa9x", b""]
    assert len({tuple(c.tolist()) for c in lines.characters(odd)}) == len(odd)
    for k in (1, 2):
        want = np.array([lev(x, y) <= k for x, y in zip(a, b)])
        assert (lines.within(p, q, k) == want).all() and (lines.likely(p, q, k) >= want).all()


def test_op9_counts_edits_in_characters(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for n in range(8):
        y = [r.choice("abcdefghij éü\u4e2d\u6587") for _ in range(40)] + [str(n)] * 3
        for k in range(5):
            z = list(y)
            for at in r.sample(range(1, 39), k):
                z[at] = r.choice("ä\u00e1\u8a9e\U0001f600x")
            rows.append((len(rows), "".join(z)))
    rows += [(90, "the cafe on the corner sells pate daily"), (91, "the café on the corner sells paté daily")]
    seen, want = [], {}
    for i, x in rows:
        y = " ".join(x.split())
        want[i] = [0] if any(lev(y, z) <= 2 for z in seen) else []
        seen.append(y)
    assert want[91] == [0] and sum(map(len, want.values())) < len(rows) - 8
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: list(x.removed) for x in lines.op9_line_dedup(spark, f"file://{tmp_path}").collect()} == want


def test_substring(spark, docs, empty):
    t = {r[0]: (r[1] or "").encode().split() for r in corpus()}
    first = {}
    for i in sorted(t):
        for j in range(len(t[i]) - 12):
            first.setdefault(tuple(t[i][j : j + 13]), i)
    for r in spans.remove_repeats(docs).collect():
        w = t[r.doc_id]
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r.doc_id:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert spans.remove_repeats(empty).count() == 0


def test_substring_judges_rows_of_one_id_by_their_texts(spark):
    a, b, x = (" ".join(f"{c}{i}" for i in range(20)) for c in "abx")
    loop = "again " * 30
    rows = [(1, a), (2, a), (2, b), (3, b), (4, f"{b} {x}"), (4, f"{b} {x}"), (5, f"{x[4:]} {a}"), (6, loop), (7, loop * 2), (8, None), (9, ""), (None, a), (None, None), (10, "one two")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 20, 0), (2, 20, 20), (2, 20, 0), (3, 20, 20), (4, 40, 20), (4, 40, 20), (5, 39, 38), (6, 30, 0), (7, 60, 60), (8, 0, 0), (9, 0, 0), (None, 20, 0), (None, 0, 0), (10, 2, 0)])


def test_substring_graph(spark):
    """Shared passages that fork at one place: the node before the fork branches, and paths end there."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(9)) for x in "abc")
    rows = spans.rows_of(spark.createDataFrame([(1, f"{a} {b}"), (2, f"{a} {c}"), (3, f"p q {a} {b} r"), (4, f"s {a} {c}"), (5, f"u {c} {c}")], "doc_id long, text string"))
    k = 3
    edge = spans.sources(spans.edges(rows, k))
    words = {1: f"{a} {b}".split(), 2: f"{a} {c}".split()}
    triples = {tuple(words[i][j : j + k]) for i in words for j in range(len(words[i]) - k + 1)}
    assert edge.count() == len(triples)
    branch = spans.branching(edge)
    assert branch.count() == 1  # a7 a8, followed by b0 or by c0
    piece = spans.pieces(edge, branch)
    assert piece.select("piece").distinct().count() == 3 and piece.where("shut").count() == 1
    assert spans.paths(piece).count() == 0
    line = spans.rows_of(spark.createDataFrame([(1, "a b c d"), (2, "z b c d e f"), (3, "a b c d e f")], "doc_id long, text string"))
    edge = spans.sources(spans.edges(line, k))
    piece = spans.pieces(edge, spans.branching(edge))
    assert sorted(r.src_at for r in edge.collect()) == [0, 1, 2, 3] and piece.select("piece").distinct().count() == 2
    assert {r.path for r in spans.paths(piece).collect()} and spans.paths(piece).select("path").distinct().count() == 1


def test_substring_digests_the_words_of_the_source(spark):
    """A span that the names of edges give wrongly: the digest is of the words at the source coordinates."""
    rows = [(1, prose(30, 1)), (2, prose(30, 2)), (3, prose(30, 1))]
    r, a = spans.rows_of(spark.createDataFrame(rows, "doc_id long, text string")), None
    wrong = r.where("doc_id = 2").select("doc_id", "key", F.lit(0).alias("at"), F.lit(20).alias("n"))
    first = r.where("doc_id = 1").first()
    a = wrong.withColumn("src", F.lit(1).cast("long")).withColumn("src_key", F.lit(first.key)).withColumn("src_at", F.lit(0))
    seen = spans.verified(r, a).first()
    assert seen.digest == spans.digest(rows[0][1].encode().split()[:20]) != spans.digest(rows[1][1].encode().split()[:20])


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)], "a long, b long")
    got = {r.id: r.label for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_chains(spark):
    links = [(i, i - 1) for i in range(100, 60, -1)] + [(i, i + 1) for i in range(0, 17)] + [(200, 201)] + [(301, 302), (302, 300), (300, 301)]
    got = {r.id: r.label for r in components.chains(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(60, 101)} | {i: 0 for i in range(18)} | {200: 200, 201: 200} | {300: 300, 301: 300, 302: 300}
    assert components.chains(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_of_null_and_blank():
    out, s, e, r, n = lines.lines_of(*text_buffer(pa.array(["  A  b\n\n c\td \r\nx", "", None, "\n", "zZ\n  \n q  q"])))
    assert [(bytes(out[a:b]), int(x), int(y)) for a, b, x, y in zip(s, e, r, n)] == [(b"a b", 0, 0), (b"c d", 0, 2), (b"x", 0, 3), (b"zz", 4, 0), (b"q q", 4, 2)]


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf).count() > 0
