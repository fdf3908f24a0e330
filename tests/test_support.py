"""Policies that refuse, ids, roll-ups, bundles of any size, callbacks, fixtures and portable plans."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators import compare, episodes, history, record
from tidemark.plans import comparison as plans
from tidemark.sources import documents, readers, reports
from tidemark.streaming import live
from tidemark.support.fixtures import Extension, FixtureBuilder, VirtualClock, metadata


def plan(**kw):
    return plans.Plan("p", plans.for_source("a"), (plans.for_source("b"),), kw.pop("comparators", plans.SIMPLE), scope_window="w", **kw)


def hist(spark, *rows):
    b = FixtureBuilder()
    for source, start, end in rows:
        b.open("w", "k", start, source) if end is None else b.closed("w", "k", start, end, source)
    return b.build(spark)


def test_open_windows_without_a_policy_are_refused(spark):
    w = hist(spark, ("a", 1, None), ("b", 3, 7))
    with pytest.raises(PySparkException, match="OpenWindowsWithoutPolicy"):
        compare.Comparison(w, plan()).missing().collect()
    assert compare.errors(w, plan()) == ["OpenWindowsWithoutPolicy"] and compare.errors(w, plan(horizon=9)) == []
    with pytest.raises(PySparkException, match="InvalidRangeDuration"):
        compare.Comparison(w, plan(horizon=0)).residual().collect()
    with pytest.raises(PySparkException, match="SelfComparison"):
        compare.Comparison(w, plans.Plan("p", plans.for_window("w"), (plans.for_source("b"),), ("overlap",), scope_window="w", horizon=9)).overlap().collect()


def test_containment_and_transitions_are_provisional_with_open_evidence(spark):
    w = hist(spark, ("a", 1, None), ("b", 3, 5))
    c = compare.Comparison(w, plan(horizon=9))
    assert {r.finality for r in c.containment().collect()} == {"Provisional"}
    assert [r.finality for r in c.lead_lag("Start", 5).collect()] == ["Provisional"]
    done = compare.Comparison(hist(spark, ("a", 1, 9), ("b", 3, 5)), plan(horizon=9))
    assert {r.finality for r in done.containment().collect()} == {"Final"} and not done.has_provisional() and c.has_provisional()


def test_trace_and_excluded(spark):
    w = hist(spark, ("a", 1, 9), ("a", 20, 30), ("b", 3, 5), ("c", 1, 2))
    c = compare.Comparison(w, plan(known_at=10))
    assert sorted((r.start_m, r.side, r.record_id) for r in c.trace(c.overlap()).collect()) == [(3, "against", "window-0003"), (3, "target", "window-0001")]
    assert {r.record_id: r.reason for r in compare.excluded(w, plan(known_at=10)).collect()} == {"window-0002": "FutureWindow", "window-0004": "NotSelected"}


def test_record_ids_of_differing_parts_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a", "\\n"), ("a\\", "b"), ("a", "\\pb")]
    ids = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(record.record_id("x", "y")).collect()]
    assert len(set(ids)) == len(rows)


def test_null_and_empty_partitions_are_unrelated(spark):
    b = FixtureBuilder().closed("w", "k", 0, 5, "a").closed("w", "k", 0, 5, "b", partition="")
    assert {r.kind for r in episodes.relations(b.build(spark), "a", "b", 0, 0).collect()} == {"UnmatchedTarget", "UnmatchedAgainst"}


def test_relations_equal_all_pairs(spark):
    import random

    r = random.Random(4)
    rows = []
    for source in "ab":
        at = 0
        for _ in range(60):
            at += r.choice([0, 1, 2, 5, 40, 300])
            end = at + r.choice([0, 1, 3, 10, 200])
            rows.append((source, at, end))
            at = end
    w = hist(spark, *rows)
    for stitch, tol in ((0, 0), (3, 2), (1, 50)):
        f = {s: [(x.episode_id, x.s, x.e) for x in episodes.fragments(w.where(F.col("source") == s), stitch).collect()] for s in "ab"}
        link = {x[0]: {x[0]} for s in "ab" for x in f[s]}
        for i, s1, e1 in f["a"]:
            for j, s2, e2 in f["b"]:
                if s1 <= e2 + tol and s2 <= e1 + tol and link[i] is not link[j]:
                    link[i] |= link[j]
                    for x in link[i]:
                        link[x] = link[i]
        got = {}
        for x in episodes.relations(w, "a", "b", stitch, tol).collect():
            got.setdefault(x.component, set()).add(x.episode_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, {id(v): v for v in link.values()}.values()))


def test_residuals_and_overlaps_equal_all_pairs(spark):
    import random

    r = random.Random(7)
    rows = [(r.choice("abc"), s, s + r.randint(1, 60)) for s in (r.randint(0, 900) for _ in range(80))]
    w = hist(spark, *rows)
    for width in (None, 7, 5000):
        got = {(x.first_record_id, x.second_record_id) for x in history.find_overlaps(w, width).collect()}
        want = {(i, j) for i, (_, a, b) in enumerate(rows) for j, (_, c, e) in enumerate(rows) if a < e and c < b and (a, b, f"window-{i + 1:04d}") < (c, e, f"window-{j + 1:04d}")}
        assert got == {(f"window-{i + 1:04d}", f"window-{j + 1:04d}") for i, j in want}
    free = {i: [p for p in range(a, b) if not any(s != "a" and c <= p < e for s, c, e in rows)] for i, (s0, a, b) in enumerate(rows) if s0 == "a"}
    got = {}
    for x in history.find_residuals(w, "a").collect():
        got.setdefault(x.record_id, []).extend(range(x.start_position, x.end_position))
    assert {k: sorted(v) for k, v in got.items()} == {f"window-{i + 1:04d}": v for i, v in free.items() if v}


def test_overlaps_of_windows_of_any_length_are_merged_from_few_rows(spark):
    import random

    r = random.Random(11)
    rows = [(r.choice("abc"), s, s + (r.randint(0, 10 ** r.randint(1, 13)) if i % 9 else 0)) for i, s in enumerate(r.randint(0, 10 ** r.randint(2, 13)) for _ in range(70))]
    rows += [("a", 500, 500), ("b", 500, 1000), ("c", 1000, 1500), ("a", 0, 4001), ("b", 4000, 8000)]
    w = hist(spark, *rows)
    ids = [(a, b, f"window-{i + 1:04d}") for i, (_, a, b) in enumerate(rows)]
    want = sorted((p[2], q[2], q[0], min(p[1], q[1])) for p in ids for q in ids if p[0] < q[1] and q[0] < p[1] and p < q)
    for width in (None, 1, 500):
        found = history.find_overlaps(w, width)
        assert sorted(tuple(x) for x in found.select("first_record_id", "second_record_id", "overlap_start", "overlap_end").collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the rows of bins, which no estimate knows, stay off the driver


def test_open_evidence_of_a_sequence_is_refused(spark):
    with pytest.raises(PySparkException, match="open evidence"):
        episodes.match_sequence(hist(spark, ("a", 1, None)), ["w"], 1).collect()


def sequence_brute(rows, steps, gap):
    """rows: (family, start, end, id). Scans from the start for every step."""
    fam = {n: sorted((e, s, i) for f, s, e, i in rows if f == n) for n in steps}
    used, out = set(), []
    for first in fam[steps[0]]:
        if first[2] in used:
            continue
        chain = [first]
        for n in steps[1:]:
            e, s, _ = chain[-1]
            nxt = next((c for c in fam[n] if c[2] not in used and c[2] not in {x[2] for x in chain} and c[1] >= s and max(0, c[1] - e) <= gap), None)
            if nxt is None:
                break
            chain.append(nxt)
        else:
            used |= {x[2] for x in chain}
            out.append(",".join(x[2] for x in chain))
    return sorted(out)


def test_sequences_equal_a_plain_scan(spark):
    import random

    r = random.Random(11)
    for steps in (["A", "B", "C"], ["A", "A"], ["B"]):
        b, rows = FixtureBuilder(), []
        for n in range(90):
            f, s = r.choice("ABC"), r.randint(0, 300)
            e = s + r.randint(0, 25)
            b.closed(f, "k", s, e, "a")
            rows.append((f, s, e, f"window-{n + 1:04d}"))
        assert sorted(x.record_ids for x in episodes.match_sequence(b.build(spark), steps, 6).collect()) == sequence_brute(rows, steps, 6)


def test_projection_refuses_two_segments_of_one_name(spark):
    obs = spark.createDataFrame([([("a", "1", None), ("b", "2", "a")],)], "segments array<struct<name:string,value:string,parent_name:string>>")
    got = record.project_segments(obs, rename={"a": "z"}, transform={"b": lambda v: F.concat(v, F.lit("!"))}).first().segments
    assert [tuple(s) for s in got] == [("z", "1", None), ("b", "2!", "z")]
    assert [tuple(s) for s in record.project_segments(obs, drop=["a"]).first().segments] == [("b", "2", None)]
    with pytest.raises(PySparkException, match="two segments"):
        record.project_segments(obs, rename={"a": "b"}).collect()


def test_boundary_changes_pair_by_name(spark):
    seg = lambda *x: [(n, v, None) for n, v in x]
    rows = [(1, True, seg(("a", "1"), ("b", "2"))), (2, True, seg(("b", "3"), ("a", "1"), ("c", "4")))]
    obs = spark.createDataFrame([(p, "w", "k", "s", None, on, s, [], None) for p, on, s in rows], "pos long, window_name string, key string, source string, partition_id string, active boolean, segments array<struct<name:string,value:string,parent_name:string>>, tags array<struct<name:string,value:string>>, time timestamp")
    first = next(r for r in record.record(obs).collect() if r.start_position == 1)
    assert sorted(tuple(c) for c in first.boundary_changes) == [("b", "2", "3"), ("c", None, "4")]


def test_plans_are_read_back(spark):
    sel = (plans.for_source("a") | plans.for_sources(["c", "d"])) & plans.for_position_range(0, 50) & plans.for_partition(None)
    p = plans.Plan("p", sel.with_name("mine"), (plans.for_cohort(["b", "e"], "at-least", 1),), ("overlap", "lead-lag:Start:ProcessingPosition:5"), "w", (("x", "1"),), (("t", "2"),), horizon=9, coalesce=True, strict=True)
    q = plans.Plan.from_json(p.to_json())
    assert q.to_json() == p.to_json() and q.fingerprint() == p.fingerprint() and q.target.name == "mine" and q.cohort == p.cohort
    w = hist(spark, ("a", 1, 5), ("a", 60, 70), ("z", 1, 5))
    assert [r.start_position for r in w.where(q.target.predicate).collect()] == [1]
    for bad in ('{"format": "x"}', p.to_json().replace('"mine"', '"mine", "extra": 1', 1).replace('"version": 1', '"version": 2')):
        with pytest.raises(ValueError):
            plans.Plan.from_json(bad)
    with pytest.raises(ValueError):
        plans.Plan("p", plans.runtime_only("r", F.lit(True)), (plans.for_source("b"),), ("overlap",)).to_json()


def test_results_are_whole_and_comparable(spark, tmp_path, capsys):
    n = 10_050
    w = spark.range(n).selectExpr("'w' window_name", "cast(id as string) key", "'a' source", "cast(null as string) partition_id", "id * 10 start_position", "id * 10 + 5 end_position", "cast(null as timestamp) start_time",
                                  "cast(null as timestamp) end_time", "cast(array() as array<struct<name:string,value:string,parent_name:string>>) segments", "cast(array() as array<struct<name:string,value:string>>) tags", "concat('r', id) record_id")
    c = compare.Comparison(w, plan(comparators=("residual",)))
    documents.write_bundle(str(tmp_path / "b"), reports.bundle_files(c, traces={"residual": c.residual().where("start_m < 50")}))
    files = documents.read_bundle(str(tmp_path / "b"))
    got = json.loads(files["result.json"])
    assert len(got["rows"]["residual"]) == n and got["complete"] and len(files["trace-residual.jsonl"].splitlines()) == 5
    fewer = json.loads(files["result.json"])
    gone = fewer["rows"]["residual"].pop()
    fewer["rows"]["residual"][0]["finality"] = "Provisional"
    assert [(x["change"], x["row"]) for x in documents.diff(got, fewer)] == [("Retracted", gone), ("Revised", fewer["rows"]["residual"][0])]
    with pytest.raises(ValueError):
        documents.diff(got, got | {"complete": False})
    (tmp_path / "b" / "plan.json").write_text("{}")
    with pytest.raises(ValueError):
        documents.read_bundle(str(tmp_path / "b"))
    assert json.loads(reports.redacted_context(c, limit=7))["rowsLeftOut"] == n - 7


def test_json_lines_begin_with_a_summary(spark, tmp_path):
    c = compare.Comparison(hist(spark, ("a", 1, 5), ("b", 3, 7)), plan(comparators=("overlap", "residual")))
    readers.export_json_lines(c.run(), str(tmp_path / "x"), c.plan)
    lines = [json.loads(x) for d in sorted((tmp_path / "x").iterdir()) for f in sorted(d.glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0]["rows"] == {"overlap": 1, "residual": 1} and [x["comparator"] for x in lines[1:]] == ["overlap", "residual"] and all("finality" in x for x in lines[1:])


def test_fixtures_are_checked(spark, tmp_path):
    doc = {"windows": [{"windowName": "w", "key": "k", "source": s, "startPosition": a, "endPosition": b} for s, a, b in (("a", 1, 5), ("b", 3, 7))],
           "plan": {"name": "p", "targetSource": "a", "againstSources": ["b"], "scopeWindow": "w", "comparators": ["overlap"]}, "expected": {"overlap": 1}}
    assert documents.run_fixture(spark, doc)["matches"]
    (tmp_path / "f").write_text(json.dumps(doc | {"expected": {"overlap": 2}}))
    assert main(["compare", str(tmp_path / "f")]) == 1
    for bad in ({"windows": []}, doc | {"version": 2}, doc | {"plan": {"name": "p"}}, doc | {"windows": [{"key": "k"}]}, doc | {"windows": [{"key": "k", "startPosition": 5, "endPosition": 1}]}):
        with pytest.raises(ValueError):
            documents.run_fixture(spark, bad)


def test_import_refuses_positions_that_move_backwards(spark):
    ev = spark.createDataFrame([(1, "s", "5", "on", "k"), (2, "s", "4", "off", "k")], "n int, source string, position string, status string, id string")
    m = {"input": "csv", "source": "source", "position": "position", "key": "id", "windows": [{"name": "On", "active": {"field": "status", "equals": "on"}}]}
    with pytest.raises(PySparkException, match="backwards"):
        readers.import_events(ev, m, order="n").collect()
    assert readers.import_events(ev.where("n = 1"), m, order="n").count() == 1


def test_debounce_with_both_predicates_equals_a_plain_loop(spark):
    import random

    r = random.Random(8)
    rows = [(n, "w", f"k{n % 3}", "s", None, r.choice([True, False, None]), r.choice([True, False, None])) for n in range(300)]
    df = spark.createDataFrame(rows, "pos long, window_name string, key string, source string, partition_id string, enter boolean, leave boolean")
    for up, down in ((1, 1), (2, 3)):
        state, want = {}, []
        for pos, _, key, _, _, a, z in rows:
            on, n = state.get(key, (False, 0))
            n = n + 1 if (z if on else a) else 0
            if n >= (down if on else up):
                on, n = not on, 0
            state[key] = on, n
            want.append((pos, on))
        assert sorted((x.pos, x.active) for x in record.stabilise_two(df, "enter", "leave", up, down).collect()) == want


def test_callbacks(spark):
    seen = []

    def wrong(row):
        raise KeyError(row["kind"])

    calls = live.Callbacks().on_opened(lambda r: seen.append(("o", r.position))).on_emission(wrong).on_closed(lambda r: seen.append(("c", r.position)))
    with pytest.raises(ExceptionGroup) as e:
        calls(record.transitions(hist(spark, ("a", 1, 5))))
    assert sorted(seen) == [("c", 5), ("o", 1)] and len(e.value.exceptions) == 2


def test_streamed_watermarks_equal_the_tracker(spark, tmp_path):
    import random

    r = random.Random(5)
    clock, rows = {"x": 0, "y": 0}, []
    for n in range(400):
        lane, kind = r.choice("xy"), r.choices(["Advance", "Observe", "Remove"], [3, 9, 0.2])[0]
        clock[lane] += kind == "Advance" and r.randint(0, 4)
        time = clock[lane] - (r.random() < 0.05) * 3 if kind == "Advance" else clock[lane] + r.randint(-12, 6)
        rows.append((lane, n, kind, f"e{r.randint(0, 25)}", f"r{r.randint(0, 2)}", time))
    w, want = live.BoundedWatermark(3), []
    for lane, n, kind, event, revision, time in rows:
        if kind == "Remove":
            w.remove(lane)
        elif kind == "Advance":
            want += [(lane, n, e, v, *x) for e, v, x in w.advance(lane, time)]
        else:
            want.append((lane, n, event, revision, *w.observe(lane, event, revision, time)))
    form = "lane string, seq long, kind string, event string, revision string, time long"
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.watermark_stream(stream, 3).writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda x: tuple(map(str, x))
    got = sorted((tuple(x) for x in spark.table("marks").collect()), key=key)
    assert got == sorted(want, key=key) and {x[4] for x in want} >= {"Accepted", "Buffered", "Corrected", "Rejected"}


def test_live_batches_remember_earlier_windows(spark, tmp_path):
    form = "key string, source string, partition_id string, kind string, start_position long, position long, segments string"
    batches = [[("k", "a", "p", "Opened", 1, 1, "[]")], [("k", "b", "p", "Opened", 2, 2, "[]"), ("k", "a", "p", "Closed", 1, 4, "[]")], [("k", "b", "p", "Closed", 2, 6, "[]")]]
    out = []

    class Stream:
        class writeStream:
            @staticmethod
            def foreachBatch(fn):
                for n, rows in enumerate([*batches, batches[2]]):
                    fn(spark.createDataFrame(rows, form), min(n, 2))

    live.live_batches(Stream, lambda df, n: out.append((n, sorted((r.source, r.start_position, r.end_position) for r in df.collect()))), lambda w, h: w.withColumn("end_position", F.coalesce("end_position", F.lit(h))), str(tmp_path / "s"))
    assert out == [(0, [("a", 1, 1)]), (1, [("a", 1, 4), ("b", 2, 4)]), (2, [("a", 1, 4), ("b", 2, 6)]), (2, [("a", 1, 4), ("b", 2, 6)])]


def test_fixture_builder_clock_metadata_and_extension(spark):
    with pytest.raises(ValueError, match="open twice"):
        FixtureBuilder().open("w", "k", 1).open("w", "k", 2).build(spark)
    with pytest.raises(ValueError, match="end before start"):
        FixtureBuilder().closed("w", "k", 5, 2).build(spark)
    c = VirtualClock(5)
    assert c.advance(3) == 8 and c.now == 8
    with pytest.raises(ValueError):
        c.move_to(7)
    d = record.WindowDefinition("w", F.lit(True), F.lit("k"), tags={"t": F.lit(1)})
    assert metadata([d], {"up": "w", "top": "up"})[0]["rollUps"] == [{"name": "up", "rollUps": [{"name": "top", "rollUps": []}]}]
    assert Extension("x", comparators=("a",)).version == "1"
    for bad in ({"name": " "}, {"name": "x", "comparators": ("a", "a")}):
        with pytest.raises(ValueError):
            Extension(**bad)
