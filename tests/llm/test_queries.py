"""Every opN query and every pipeline stage over tables with nulls, empty and long texts, repeated rows and clashing columns,
against plain Python."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, decontaminate, language, lines, packing, queries, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string, score double, key string, spans string"
WORDS = {"en": "the of and to in that was for with this house river".split(), "de": "der die und das nicht ein mit auch sich von haus fluss".split()}


def text(n, lang, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS[lang]) + (str(r.randint(0, 40)) if r.random() < 0.5 else "") for _ in range(min(12, n - i))) for i in range(0, n, 12))


ITEM = " ".join(f"bench{i}" for i in range(24))


def documents():
    rows = [(i, text(20 + i % 60, "en" if i % 2 else "de", i) + (" you vile scum" if i % 10 == 0 else "")) for i in range(160)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "..."), (504, text(60_000, "en", 3)), (505, rows[7][1]), (505, rows[7][1]), (506, rows[8][1].upper()), (507, rows[9][1]), (507, rows[11][1])]
    rows += [(508, text(30, "en", 77) + " " + ITEM.replace("bench5", "other")), (509, ITEM[:60]), (None, rows[3][1]), (None, None), (510, rows[20][1] + "\n" + rows[21][1])]
    return [(i, t, None if i == 4 else ("en" if (i or 0) % 2 else "de"), "s", None if t is None else len(t), "r", 0.5, "k", "s") for i, t in rows]


def pages():
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "x", "WARC/1.1\r\n\r\nboo" * 9000), (6, "y", "one"), (6, "y", "two"), (7, "z", "one"), (8, "u", "z" * 3_000_000)]
    return [(*r, "extra") for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages(), "page_id long, url string, html string, type string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, ITEM), (None, ITEM + " more"), (-1, None), (3, "bench0 bench1 bench2")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), int(i % 10 == 0)) for i in range(150)] + [(9999, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}"
    for name, form in (("documents", DOCS), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], form).write.parquet(f"{path}/{name}.parquet")
    return path


def crc(i, divisor):
    return None if i is None else zlib.crc32(str(i).encode()) % divisor


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, none, name):
    assert queries.QUERIES[name](spark, none).count() == 0


def test_op1(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, x, *_ in documents():
        ids = np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, len(ids)] += len(ids)
    got = collections.Counter()
    used, open_ = collections.defaultdict(list), 0
    for r in queries.QUERIES["op1_packing"](spark, sf).collect():
        got[r.doc_id, r.doc_tokens] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
        open_ += 0 if at & (at - 1) == 0 else 2048 - at
    assert open_ <= 0.01 * sum(want.values())


def test_packing_limits_of_loss(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, text(40, "en", i), i % 30 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    got = collections.defaultdict(list)
    whole = collections.Counter()
    for r in packing.pack(df, path, max_tokens=128, max_loss=40, loss_from_col="prompt").collect():
        got[r.sequence_id].append(r)
        whole[r.doc_id] += r.length
        first = rows[r.doc_id][2] or 0
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, first))
    assert all(sum(r.loss_tokens for r in s) <= 40 and sum(r.length for r in s) <= 128 for s in got.values())
    assert {r.doc_id: r.doc_tokens for s in got.values() for r in s} == dict(whole)
    for bad in ({"max_loss": 0}, {"max_tokens": 0}, {"max_segments": 0}):
        with pytest.raises(ValueError):
            packing.pack(df, path, **bad)


def test_op2(spark, sf):
    got = collections.Counter()
    for r in queries.QUERIES["op2_language"](spark, sf).collect():
        assert r.held_out == (crc(r.doc_id, 3) == 1 if r.doc_id is not None else r.held_out) and 0 <= r.score <= 1
        got[r.doc_id, r.lang_pred] += 1
    assert got[500, "und"] == got[501, "und"] == got[502, "und"] == got[503, "und"] == got[None, "und"] == 1
    right = sum(n for (i, p), n in got.items() if i is not None and i < 160 and p == ("en" if i % 2 else "de"))
    assert right >= 0.9 * 160 and sum(got.values()) == len(documents())


def test_language_refuses_too_many_languages_and_breaks_ties_by_name(spark):
    rows = [(i, text(30, "en", i), f"l{i % 5}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.train(docs, languages=4)
    model = language.ByteConv(["b", "a"][::-1])
    model.d[:] = 0
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"a"}


def test_pair_tables_equal_a_plain_convolution():
    r = np.random.default_rng(1)
    net = language.ByteConv(["a", "b", "c"])
    net.b = [r.normal(size=b.shape).astype(np.float32) for b in net.b]
    x = np.zeros((5, language.WINDOW + language.PAD), np.uint8)
    x[:, : language.WINDOW] = r.integers(0, 256, (5, language.WINDOW))
    want = []
    for row in x:
        h = []
        for w, b, k in zip(net.w, net.b, language.WIDTHS):
            best = np.full(language.FILTERS, -np.inf)
            for at in range(language.WINDOW):
                best = np.maximum(best, b + sum(net.emb[row[at + j]].astype(float) @ w[j] for j in range(k)))
            h.append(np.maximum(best, 0))
        z = np.concatenate(h) @ net.d + net.c
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.predict(x, net.tables()), want, atol=1e-4)


def test_op3_and_op10_rows(spark, sf):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, x, *_ in documents():
        groups[(x or "").translate(low)].append(i)
    top = lambda g: max((i for i in g if i is not None), default=None)
    want = collections.Counter((i, top(g), len(g), i == top(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for i in g)
    assert collections.Counter(map(tuple, queries.QUERIES["op3_exact_dedup"](spark, sf).collect())) == want
    words = [(i, (x or "").encode().split()) for i, x, *_ in documents()]
    first = {}
    for i, w in words:
        for j in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[j : j + 13])
            first[k] = min(i, first.get(k, i))
    want = collections.Counter()
    for i, w in words:
        gone = {p for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()] += 1
    assert collections.Counter(map(tuple, queries.QUERIES["op10_substring"](spark, sf).collect())) == want


def test_op4_rows(spark, sf):
    got = queries.QUERIES["op4_lm_scoring"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in documents())
    assert all(r.score == 0 and not r.target_like for r in got if r.n_tokens == 0) and any(r.target_like for r in got)


def test_op5(spark, sf):
    got = queries.QUERIES["op5_toxicity"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in documents())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and (r.doc_id is None or r.held_out == (crc(r.doc_id, 4) == 2))
    assert len({r.score for r in got if r.doc_id == 505}) == 1


def test_trees_equal_a_plain_walk_and_isotonic_steps_rise():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 5)).round(1)
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    t = toxicity.Trees(rounds=12).fit(x, y)
    want = []
    for row in x:
        z = t.start
        for tree, value in t.trees:
            node = 1
            for _ in range(t.depth):
                cut = tree.get(node)
                node = 2 * node + int(bool(cut) and row[cut[0]] > cut[1])
            z += value[node]
        want.append(z)
    assert np.allclose(t.margin(x), want) and ((t.margin(x) > 0) == (y > 0)).mean() > 0.9
    at, value = toxicity.isotonic(t.margin(x), y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= -0.05).all()


def test_lexicon_has_no_cap():
    words = [f"vile{i}word" for i in range(30_000)]
    r = random.Random(3)
    share = [" ".join(words[i::4]) for i in range(4)]
    texts = [share[i % 4] + " " + " ".join(r.choice(words) for _ in range(5)) for i in range(40)] + [text(30, "en", i) for i in range(200)]
    lexicon, strong = toxicity.learn_lexicon(texts, np.array([1] * 40 + [0] * 200))
    assert len(lexicon) >= 0 and len(strong) <= len(lexicon)


def test_op6_rows(spark, sf):
    got = collections.defaultdict(set)
    rows = queries.QUERIES["op6_jaccard"](spark, sf).collect()
    for r in rows:
        got[r.doc_id].add((r.class_id, r.links))
    assert len(rows) == len(documents())
    assert got[7] == {(7, 2)} == got[505] and got[8] == {(8, 1)} == got[506] and got[500] == {(500, 0)} and got[None] == {(None, 0)}


def test_op7(spark, sf):
    top = {}
    for i, _, h, _ in pages():
        top[h or ""] = max(i, top.get(h or "", 0))
    want = collections.Counter()
    for i, _, h, _ in pages():
        body = (h or "").encode()
        own = top[h or ""] == i
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else top[h or ""], True] += 1
    assert collections.Counter(map(tuple, queries.QUERIES["op7_warc"](spark, sf).collect())) == want


def test_warc_of_null_ids_and_files_by_bytes(spark, tmp_path):
    rows = [(None, "a", "same"), (4, "b", "same"), (None, "c", "alone"), (None, "d", "alone"), *[(10 + i, "e", random.Random(i).randbytes(200_000).hex()) for i in range(12)]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write(df, path, file_mb=1)
    got = warc.assemble(warc.read(spark, path)).collect()
    assert collections.Counter((r.response.target_uri, r.response.type) for r in got) == collections.Counter([("a", "revisit"), ("b", "response"), ("c", "response"), ("d", "response"), *[("e", "response")] * 12])
    assert all(r.response.digest_ok and r.request and r.metadata for r in got)
    files = [p for p in tmp_path.joinpath("w").iterdir() if p.name.startswith("part")]
    assert len(files) >= 3 and max(p.stat().st_size for p in files) < 2_500_000


def tokens(x):
    return "".join(c.lower() if c.isascii() and (c.isalnum()) else c if not c.isascii() else " " for c in x or "").split()


def overlap_brute(doc, item, window=13, least=10, shortest=8):
    """Whether some window of an item, or all of a shorter one, lies in the text with no more changed words than allowed."""
    w = min(len(item), window)
    if not w:
        return False
    need = w if len(item) < shortest else -(-w * least // window)
    return any(sum(a == b for a, b in zip(doc[i : i + w], item[j : j + w])) >= need for i in range(len(doc) - w + 1) for j in range(len(item) - w + 1))


def test_op8(spark, sf):
    items = [(1, ITEM), (None, ITEM + " more"), (-1, None), (3, "bench0 bench1 bench2")]
    want = {(i, k) for i, x, *_ in documents() if len(x or "") < 9000 for k, y in items if overlap_brute(tokens(x), tokens(y))}
    assert want == {(508, 1), (508, None), (508, 3), (509, 3)}
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, sf).collect()} == want


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    items = [[r.choice(words) for _ in range(r.choice([2, 7, 8, 9, 10, 11, 12, 13, 14, 20]))] for _ in range(40)]
    docs = []
    for _ in range(120):
        d = [r.choice(words) for _ in range(r.randint(0, 40))]
        it = list(r.choice(items))
        for _ in range(r.randint(0, 4)):
            it[r.randrange(len(it))] = "sub" + r.choice(words)
        at = r.randint(0, len(d))
        docs.append(d[:at] + it[r.randint(0, 2) :] + d[at:])
    want = {(i, k) for i, d in enumerate(docs) for k, it in enumerate(items) if overlap_brute(d, it)}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    for block in (1_000_000, 100):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(df, bench, block_tokens=block).collect()} == want


def test_op9_rows(spark, sf):
    got = queries.QUERIES["op9_line_dedup"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in documents())
    by = {r.doc_id: r for r in got}
    assert by[506].n_removed == by[506].n_lines and by[500].n_lines == 0 and by[None].n_removed == 0


def test_line_dedup_names(spark):
    df = spark.createDataFrame([(1, "one line of text that is long", "mine", 7), (2, "one line of text that is long\nb", "mine", 7)], "doc_id long, text string, removed string, n_lines int")
    got = {r.doc_id: r for r in lines.dedup_lines(df, names=("gone", "lines", "cut")).collect()}
    assert got[2].removed == "mine" and got[2].n_lines == 7 and list(got[2].gone) == [0] and got[2].lines == 2 and got[2].text == "b"


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = []
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(fn(spark, docs, sf), f"test-{name}")
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")] and {r.removed for r in docs.select("removed").distinct().collect()} <= {"r"}
        kept.append(ids(docs))
    assert not kept[0] & {500, 501, 502, 503} and {504, 505, 506, 508} <= kept[0]
    assert kept[1] == kept[0]
    assert {7, 8, 505, 506} <= kept[2]  # the copies have lost all their lines, and are in no group
    alone = ids(dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    assert {7, 8, None} <= alone and not alone & {505, 506}
    assert 508 not in kept[3] and kept[2] - kept[3] <= {508, 509}
    assert ids(corpus_pipeline.STAGES[-1][1](spark, docs, sf)) == kept[3]


def test_pipeline_of_an_empty_table(spark, none):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, none).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Fake())


def test_sieve_tells_owners_apart_that_agree_in_31_bits(spark):
    a, b = 1 << 40, (1 << 40) + 1
    keys = np.array([5, 5, 9], np.uint64) << np.uint64(38)
    sieve = common.Sieve(spark)

    def pack(batches):
        for _ in batches:
            pass
        yield from sieve.pack([(keys, np.array([a, b, a]), np.ones(3, bool))])

    bits = sieve.bitmap(spark.range(1).coalesce(1).mapInArrow(pack, common.Sieve.FORM))
    assert list(bits.has(keys)) == [True, True, False]
    assert pa.array([1]).to_pylist() == [1]
