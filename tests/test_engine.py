"""Golden cases of the interval engine, and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import temporal
from tidemark.operators import compare, episodes, governance, history, record
from tidemark.plans import comparison as plans
from tidemark.plans import registry
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"
FORM = "window_name string, key string, source string, partition_id string, start_position long, end_position long, record_id string, segments array<struct<name:string,value:string,parent_name:string>>, tags array<struct<name:string,value:string>>"


def hist(spark, *rows):
    """rows: (source, start, end[, window])"""
    return spark.createDataFrame([(r[3] if len(r) > 3 else "w", "k", r[0], None, r[1], r[2], f"{r[0]}{n}", [], []) for n, r in enumerate(rows)], FORM)


def comp(spark, *rows, against=None, **kw):
    return compare.Comparison(hist(spark, *rows), plans.Plan("p", plans.for_source("a"), (against or plans.for_source("b"),), plans.SIMPLE, scope_window="w", **kw))


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_overlap_residual_coverage(spark):
    c = comp(spark, ("a", 1, 5), ("b", 3, 7))
    assert got(c.overlap(), "start_m", "end_m") == [(3, 5)]
    assert got(c.residual(), "start_m", "end_m") == [(1, 3)]
    assert got(c.missing(), "start_m", "end_m") == [(5, 7)]
    assert c.coverage().count() == 2
    assert got(c.symmetric_difference(), "start_m", "end_m", "side") == [(1, 3, "Target"), (5, 7, "Against")]


def test_zero_length_window_splits_a_segment(spark):
    c = comp(spark, ("a", 1, 5), ("a", 3, 3))
    assert got(c.residual(), "start_m", "end_m") == [(1, 3), (3, 5)]


def test_gap_only_between_segments(spark):
    assert got(comp(spark, ("a", 1, 3), ("b", 5, 7)).gap(), "start_m", "end_m") == [(3, 5)]
    assert comp(spark, ("a", 1, 3)).gap().count() == 0


def test_containment(spark):
    c = comp(spark, ("a", 1, 7), ("b", 3, 5)).containment()
    assert got(c, "start_m", "end_m", "status") == [(1, 3, "LeftOverhang"), (3, 5, "Contained"), (5, 7, "RightOverhang")]


@pytest.mark.parametrize("activity,count,residual", [("any", None, []), ("all", None, [(1, 6), (6, 11)]), ("at-least", 1, []), ("none", None, [(1, 6), (6, 11)])])
def test_cohorts(spark, activity, count, residual):
    c = comp(spark, ("a", 1, 11), ("b", 1, 6), ("c", 6, 11), against=plans.for_cohort(["b", "c"], activity, count))
    assert got(c.residual(), "start_m", "end_m") == residual


@pytest.mark.parametrize("start,direction,tol,status,distance", [(10, "Previous", 5, "Exact", 0), (7, "Previous", 5, "Matched", 3), (12, "Previous", 5, "FutureRejected", 2), (5, "Previous", 2, "NoMatch", 5), (12, "Next", 5, "Matched", 2)])
def test_as_of(spark, start, direction, tol, status, distance):
    assert got(comp(spark, ("a", 10, 20), ("b", start, 30)).as_of(direction, tol), "status", "distance") == [(status, distance)]


def test_lead_lag_tie_takes_the_least_id(spark):
    assert got(comp(spark, ("a", 10, 20), ("b", 12, 30), ("b", 8, 30)).lead_lag("Start", 2), "against_id", "delta") == [("b1", -2)]


def test_hierarchy(spark):
    h = compare.hierarchy(hist(spark, ("a", 1, 7, "p"), ("a", 3, 5, "c")), "p", "c")
    assert got(h, "start_m", "kind") == [(1, "UnexplainedParent"), (3, "ParentExplained"), (5, "UnexplainedParent")]


def test_plan_checks():
    p = plans.Plan.__new__(plans.Plan)
    assert plans.parse_comparator("asof:Previous:ProcessingPosition:5") == ("asof", "Previous", "ProcessingPosition", 5)
    with pytest.raises(ValueError):
        plans.parse_comparator("nonsense")
    with pytest.raises(ValueError):
        plans.Cohort(("a", "a"))
    del p


def test_strict_broad_scope_is_an_error(spark):
    with pytest.raises(ValueError, match="BroadSelector"):
        compare.Comparison(hist(spark, ("a", 1, 2)), plans.Plan("p", plans.for_source("a"), (plans.for_source("b"),), ("overlap",), strict=True))


def test_episodes(spark):
    e = episodes.form(hist(spark, ("a", 0, 5), ("a", 7, 9), ("a", 12, 14)), 2)
    assert got(e, "start_m", "active", "elapsed", "internal_gap") == [(0, 7, 9, 2), (12, 2, 2, 0)]
    assert got(episodes.form(hist(spark, ("a", 0, 5), ("a", 3, 8)), 0), "active") == [(8,)]


@pytest.mark.parametrize("rows,stitch,tol,kinds", [
    ([("a", 0, 10), ("b", 0, 4), ("b", 6, 10)], 0, 0, {"Split"}), ([("a", 0, 4), ("a", 6, 10), ("b", 0, 10)], 0, 0, {"Merge"}),
    ([("a", 0, 4), ("a", 6, 10), ("b", 0, 6), ("b", 7, 10)], 0, 0, {"Complex"}), ([("a", 0, 2), ("b", 4, 6)], 0, 2, {"OneToOne"}),
    ([("a", 0, 2), ("b", 4, 6)], 0, 1, {"UnmatchedTarget", "UnmatchedAgainst"}), ([("a", 0, 2), ("a", 8, 10), ("b", 4, 6)], 6, 1, {"UnmatchedTarget", "UnmatchedAgainst"})])
def test_relations(spark, rows, stitch, tol, kinds):
    assert {r["kind"] for r in episodes.relations(hist(spark, *rows), "a", "b", stitch, tol).collect()} == kinds


def test_sequences(spark):
    rows = [("a", 0, 10, "W"), ("a", 3, 6, "O"), ("a", 7, 8, "R")]
    assert got(episodes.match_sequence(hist(spark, *rows), ["W", "O", "R"], 1), "start_m", "end_m", "total_gap") == [(0, 10, 1)]
    rows = [("a", 0, 1, "Q"), ("a", 4, 5, "P")]
    assert episodes.match_sequence(hist(spark, *rows), ["Q", "P"], 2).count() == 0
    assert episodes.match_sequence(hist(spark, *rows), ["Q", "P"], 3).count() == 1


def obs(spark, *active, key="k"):
    return spark.createDataFrame([(n + 1, "w", key, "a", None, bool(x), [], [], None) for n, x in enumerate(active)], "pos long, window_name string, key string, source string, partition_id string, active boolean, segments array<struct<name:string,value:string,parent_name:string>>, tags array<struct<name:string,value:string>>, time timestamp")


def test_recording_and_debounce(spark):
    o = obs(spark, 0, 1, 1, 0, 1)
    assert got(record.record(o), "start_position", "end_position") == [(2, 4), (5, None)]
    two = record.record(record.stabilise(obs(spark, 1, 0, 1, 1, 0, 1, 0, 0, 0), 2, 3))
    assert got(two, "start_position", "end_position") == [(4, 9)]
    both = record.stabilise_two(o.withColumn("up", F.col("active")).withColumn("down", ~F.col("active")), "up", "down")
    assert got(record.record(both), "start_position", "end_position") == [(2, 4), (5, None)]


def test_changelog_replays(spark):
    p = spark.createDataFrame([("x", "Provisional"), ("y", "Final")], "row_id string, finality string")
    c = spark.createDataFrame([("x", "Final"), ("z", "Final")], "row_id string, finality string")
    log = governance.changelog(p, c)
    assert got(log, "row_id", "change") == [("x", "Revised"), ("y", "Retracted"), ("z", "Added")]
    assert got(governance.replay(p, log), "row_id", "finality") == got(c, "row_id", "finality")


def test_watermark():
    w = live.BoundedWatermark(2)
    w.advance("l", 10)
    assert w.observe("l", "e", 1, 8) == ("Accepted", None)
    assert w.observe("l", "f", 1, 7) == ("Rejected", None)
    w = live.BoundedWatermark(2)
    w.advance("l", 10)
    w.observe("l", "e1", "r1", 9)
    w.advance("l", 11)
    assert w.observe("l", "e1", "r2", 8) == ("Corrected", "r1")
    w.observe("l", "b", "r", 15)
    assert w.advance("l", 16)[0][:2] == ("b", "r")


def test_watermark_corrects_until_another_lateness_behind_it():
    w = live.BoundedWatermark(2)
    w.advance("l", 10)
    w.observe("l", "e", "r1", 9)
    w.advance("l", 13)  # watermark 11, corrections from 9 on
    assert w.observe("l", "e", "r2", 9) == ("Corrected", "r1")
    assert w.observe("l", "e", "r2", 9) == ("Accepted", None)
    assert w.observe("l", "e", "r2", 8) == ("Rejected", None)  # the same revision, but too old
    assert w.observe("l", "g", "r1", 10) == ("Rejected", None)  # late, and nothing to correct
    w.advance("l", 14)  # corrections from 10 on: e is forgotten
    assert w.observe("l", "e", "r3", 11) == ("Rejected", None)
    assert w.observe("l", "e", "r3", 12) == ("Accepted", None)


def test_watermark_waits_for_first_progress_and_ignores_stale_progress():
    w = live.BoundedWatermark(1)
    assert [w.observe("l", e, "r", t) for e, t in (("b", 4), ("a", 4), ("c", 9))] == [("Buffered", None)] * 3
    assert w.advance("l", 4) == [("a", "r", ("Accepted", None)), ("b", "r", ("Accepted", None))]
    assert w.advance("l", 4) == w.advance("l", 3) == [] and w.progress["l"] == 4
    assert w.remove("l") and not w.remove("l")
    assert w.advance("l", 20) == []


def test_liveness():
    t = live.Liveness(["x", "y"], 0, 5)
    assert t.observe("x", 2) == [("x", "Alive", 2)]
    assert t.check(5) == [("y", "Silent", 5)]
    assert t.check(7) == [("x", "Silent", 7)]
    assert t.check(9) == []


def test_liveness_orders_each_lane_for_itself():
    t = live.Liveness(["x", "y"], 0, 5)
    t.observe("x", 4)
    assert t.observe("y", 3) == [("y", "Alive", 3)]  # earlier than x, but not than y
    with pytest.raises(ValueError):
        t.observe("x", 3)
    t.check(6)
    for lane, at in (("y", 5), ("z", 9)):
        with pytest.raises(ValueError):
            t.observe(lane, at)
    for lanes, threshold in (([], 5), (["x", "x"], 5), (["x"], 0)):
        with pytest.raises(ValueError):
            live.Liveness(lanes, 0, threshold)


def test_silences_of_lanes_that_are_seen_late_or_never(spark):
    seen = spark.createDataFrame([("a", 2), ("b", 9)], "lane string, pos long")
    lanes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "lane string")
    assert got(live.silences(seen, 5, 10, lanes), "lane", "silent_at", "alive_at") == [("a", 7, None), ("b", 5, 9), ("c", 5, None)]


def test_rules_judge_the_plans_own_comparators(spark):
    h = hist(spark, ("a", 0, 10), ("b", 4, 6))
    rules = [governance.Rule("cover", "minimum_coverage", 0.9), governance.Rule("rest", "maximum_residual", 3), governance.Rule("lag", "maximum_lead_lag", 3), governance.Rule("codes", "allowed_diagnostics", codes=("BroadSelector",))]
    p = plans.Plan("p", plans.for_source("a"), (plans.for_source("b"),), ("overlap",))
    ask = lambda *c: sorted(r.rule for r in governance.assess(compare.Comparison(h, plans.replace(p, comparators=c)), rules).collect())
    assert ask("overlap") == []
    assert ask("coverage", "residual") == ["cover", "rest", "rest"]
    assert ask("lead-lag:Start:position:99", "lead-lag:End:position:0") == ["lag", "lag"]
    assert ask("asof:Previous:position:5") == ["codes"]


def test_points_and_ranges(spark):
    df = spark.createDataFrame([(1, 5, 5), (3, 4, 9)], "a long, b long, c long")
    a, b, c = (temporal.point(x) for x in "abc")
    r, q = temporal.closed(a, b), temporal.with_effective_end(b, c, "OpenAtHorizon")
    cols = [temporal.compare_points(b, c), temporal.range_length(r), temporal.range_holds(r, a), temporal.range_holds(r, b), temporal.ranges_overlap(r, q), temporal.range_empty(q), q["status"]]
    assert [tuple(x) for x in df.select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).collect()] == [(0, 4, True, False, False, True, "OpenAtHorizon"), (-1, 1, True, False, False, False, "OpenAtHorizon")]
    utc, gps = (temporal.point("a", "timestamp", x) for x in ("utc", "gps"))
    for bad in (temporal.compare_points(a, utc), temporal.compare_points(utc, gps), temporal.range_length(temporal.unended(a)), temporal.range_length(r, "timestamp"), temporal.range_holds(r, utc)):
        with pytest.raises(Exception, match="axes|clocks|without an end|not a range"):
            df.select(bad.alias("x")).collect()
    assert df.select(temporal.compare_points(utc, utc).alias("x")).distinct().first()[0] == 0
    for call in (lambda: temporal.point("a", "phase"), lambda: temporal.with_effective_end(a, b, "Closed")):
        with pytest.raises(ValueError):
            call()


def test_annotations_on_the_horizons_axis_and_clock(spark):
    rows = [("w", "n", 1, 1, "position", None), ("w", "n", 2, 2, "timestamp", "utc"), ("w", "n", 3, 3, "timestamp", None), ("w", "n", 4, 9, None, None), ("w", "n", 5, None, None, None)]
    notes = spark.createDataFrame(rows, "target string, name string, seq long, known_at long, axis string, clock string")
    ask = lambda *x: got(history.annotations_known_at(notes, *x), "seq", "revision")
    assert ask(8) == [(1, 1)] and ask(9) == [(1, 1), (4, 4)]
    assert ask(8, "timestamp", "utc") == [(2, 2)] and ask(8, "timestamp") == [(3, 3)] and ask(1, "timestamp", "utc") == []
    with pytest.raises(ValueError):
        history.annotations_known_at(notes, 1, "phase")
    assert got(history.annotations_known_at(notes.drop("axis", "clock"), 3), "seq") == [(1,), (2,), (3,)]


def test_hierarchy_warnings(spark):
    ask = lambda *rows: got(compare.hierarchy_diagnostics(hist(spark, *rows), "up", "down"), "code", "path")
    assert ask(("a", 0, 5, "up"), ("a", 1, 2, "down"), ("a", 3, None, "other")) == []
    assert ask(("a", 0, None, "up")) == [("HierarchyOpenWindowsWithoutHorizon", "windowNames"), ("MissingLineage", "childWindowName")]
    assert ask(("a", 0, 5, "other")) == [("MissingLineage", "childWindowName"), ("MissingLineage", "parentWindowName")]


def test_duplicates_and_latest(spark):
    h = hist(spark, ("a", 1, 5), ("b", 0, 9))
    assert got(history.Query(h).latest(), "source") == [("b",)]
    assert history.find_overlaps(h).count() == history.find_overlaps(h, 3).count() == 1


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in ("events", "customer"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    b = c.sql(registry.SQL[name]).df()
    a = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(a.columns) == sorted(b.columns)
    flat = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in (float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert flat(a) == flat(b)
