"""Further queries over the driver's tables: finality, policies, roll-ups with contexts, episodes' summaries, totals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import temporal
from tidemark.operators import compare, episodes, governance, history, record
from tidemark.plans import comparison as plans
from tidemark.plans.registry import A1, ASOF, BASE, CLIP, EPI, FIN, H, HIER, K, LANES, NEAR, PAIRS, POS, REL, SQL, TOL, W, WCOLS, comp, definition, events, families, horizon, obs, plan, query, rel, seg, win, windows
from tidemark.streaming import live

FINAL = "case when {} then 'Provisional' else 'Final' end"

# ------------------------------------------------------------------ finality

query("fin_containment", A1 + f""" select key, s, e, 'Contained' as status, cast(null as varchar) as rid, {FINAL.format("tp + ap > 0")} as finality from x where tn > 0 and an > 0
  union all select x.key, x.s, x.e, case when x.s = t.a then 'LeftOverhang' when x.e = t.b then 'RightOverhang' else 'NotContained' end, t.rid, {FINAL.format("t.prov")}
  from x join t on t.key = x.key and t.part = x.part and t.a <= x.s and t.b >= x.e where tn > 0 and an = 0""")(
    lambda s, d: comp(s, d).containment().select("key", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "status", F.col("record_id").alias("rid"), "finality"))
query("fin_leadlag", NEAR.format(p="b") + f" select l.key, l.rid, against_id, {FINAL.format('t.prov or coalesce(g.prov, false)')} as finality from l join t using (rid) left join g on g.rid = l.against_id")(
    lambda s, d: comp(s, d).lead_lag("End", 50).select("key", F.col("record_id").alias("rid"), "against_id", "finality"))
query("fin_asof", ASOF.format(ok="gp <= tp", future="true").rsplit("\nselect", 1)[0] + f"""
select q.key, q.rid, status, {FINAL.format("t.prov or (status in ('Exact', 'Matched', 'Ambiguous') and g.prov)")} as finality from q join t using (rid) left join g on g.rid = q.gid""")(
    lambda s, d: comp(s, d).as_of("Previous", 50).select("key", F.col("record_id").alias("rid"), "status", "finality"))
query("fin_counts", A1 + f""", y as (select 'overlap' as comparator, {FINAL.format("tp + ap > 0")} as finality from x where tn > 0 and an > 0
  union all select 'residual', {FINAL.format("tp > 0")} from x where tn > 0 and an = 0 union all select 'missing', {FINAL.format("ap > 0")} from x where tn = 0 and an > 0
  union all select 'coverage', {FINAL.format("tp + ap > 0")} from x where tn > 0 union all select 'symmetric-difference', {FINAL.format("tp + ap > 0")} from x where (tn > 0) <> (an > 0))
select comparator, finality, count(*) as rows from y group by all""")(
    lambda s, d: compare.Comparison(windows(s, d), replace(plan(horizon=horizon(s, d)), comparators=("overlap", "residual", "missing", "coverage", "symmetric-difference"))).finality_counts())
query("fin_trace", A1 + " select x.key, x.s, x.e, 'target' as side, t.rid, t.a, t.b from x join t on t.key = x.key and t.part = x.part and t.a <= x.s and t.b >= x.e where tn > 0 and an = 0")(
    lambda s, d: (lambda c: c.trace(c.residual()).select("key", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "side", F.col("record_id").alias("rid"), F.col("record_start").alias("a"), F.col("record_end").alias("b")))(comp(s, d)))
query("fin_live_horizon", A1.replace(f"coalesce(e, {H}) as b, e is null as prov from r", f"coalesce(e, {K}) as b, e is null as prov from r where s <= {K}") + " select key, part, s, e, " + FIN.format("tp > 0") + " from x where tn > 0 and an = 0")(
    lambda s, d: seg(compare.Comparison(windows(s, d).where(F.col("start_position") <= K), plan().live(K)).residual(), "finality"))
query("fin_row_ids", A1 + """ select 'overlap:' || sha256('9:HighValue|' || len(key) || ':' || key || '|' || len(part) || ':' || part || '|0:|' || len(s::varchar) || ':' || s || '|' || len(e::varchar) || ':' || e) as row_id, """
      + FIN.format("tp + ap > 0") + " from x where tn > 0 and an > 0")(
    lambda s, d: governance.identified(compare.Comparison(windows(s, d), replace(plan(horizon=horizon(s, d)), comparators=("overlap",)))).select("row_id", "finality"))

# ------------------------------------------------------------------ policies



query("nrm_open_rejected", W + """ select count(*) filter (e is null and source in ('lane-a', 'lane-b')) as open_windows, 0::bigint as missing_times, 0::bigint as self_comparison,
  count(*) filter (e is null and source in ('lane-a', 'lane-b')) > 0 as blocked from w""")(
    lambda s, d: compare.diagnostics(windows(s, d), plan()).select(F.col("OpenWindowsWithoutPolicy").alias("open_windows"), F.col("MissingEventTime").alias("missing_times"), F.col("SelfComparison").alias("self_comparison"),
                                                                  (F.col("OpenWindowsWithoutPolicy") > 0).alias("blocked")))
query("nrm_self_comparison", W + " select count(*) filter (source = 'lane-b') as self_comparison from w")(
    lambda s, d: compare.diagnostics(windows(s, d), replace(plan(), target=plans.for_window("HighValue"))).select(F.col("SelfComparison").alias("self_comparison")))


def untimed(s, d):
    """Closed windows, every fifth without its start time."""
    return windows(s, d).where("end_position is not null").withColumn("start_time", F.when(F.col("start_position") % 5 > 0, F.col("start_time")))


query("nrm_event_time", W + " select key, rid, epoch_us(st_ts) * 10 as a, epoch_us(e_ts) * 10 as b from r where e is not null and s % 5 > 0 and source in ('lane-a', 'lane-b')")(
    lambda s, d: compare.Comparison(untimed(s, d), plan(axis="timestamp", missing_time="exclude")).norm.select("key", F.col("record_id").alias("rid"), F.col("start_m").alias("a"), F.col("end_m").alias("b")))
query("nrm_missing_time", W + " select 'MissingEventTime' as reason, count(*) as n from r where e is not null and s % 5 = 0 and source in ('lane-a', 'lane-b')")(
    lambda s, d: compare.excluded(untimed(s, d), plan(axis="timestamp")).where("reason <> 'NotSelected'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
query("nrm_duplicates", W + CLIP + " select key, rid, a, b from n where source in ('lane-a', 'lane-b')")(
    lambda s, d: (lambda w: compare.Comparison(w.unionByName(w.where("source = 'lane-a'").withColumn("record_id", F.concat("record_id", F.lit("#copy")))), plan(horizon=horizon(s, d), duplicates="reject")).norm.select(
        "key", F.col("record_id").alias("rid"), F.col("start_m").alias("a"), F.col("end_m").alias("b")))(windows(s, d)))
query("nrm_record_known_at", W + f" select key, rid, s as a, coalesce(e, {H}) as b, e is null as prov from r where source in ('lane-a', 'lane-b') and coalesce(case when s % 3 = 0 then s + 400 end, e, s) <= {K}")(
    lambda s, d: compare.Comparison(windows(s, d).withColumn("known_at", F.when(F.col("start_position") % 3 == 0, F.col("start_position") + 400)), plan(horizon=horizon(s, d), known_at=K, availability="record")).norm.select(
        "key", F.col("record_id").alias("rid"), F.col("start_m").alias("a"), F.col("end_m").alias("b"), (F.col("end_status") == "OpenAtHorizon").alias("prov")))
query("prp_excluded", W + f" select rid, case when s > {K} then 'FutureWindow' else 'NotSelected' end as reason from r where s > {K} or source not in ('lane-a', 'lane-b')")(
    lambda s, d: compare.excluded(windows(s, d), plan(known_at=K)).select(F.col("record_id").alias("rid"), "reason"))
query("sel_combined", W + " select key, source, s from w where (source = 'lane-a' or source = 'lane-c') and s >= 1000 and s < 6000")(
    lambda s, d: windows(s, d).where(((plans.for_source("lane-a") | plans.for_source("lane-c")) & plans.for_position_range(1000, 6000)).with_name("some").predicate).select("key", "source", F.col("start_position").alias("s")))
T0 = 1_705_276_800_000_000_0  # 2024-01-15 in units of 100 ns
query("sel_time_range", W + f" select key, source, s from w where epoch_us(st_ts) * 10 >= {T0}")(
    lambda s, d: windows(s, d).where(plans.for_time_range(T0).predicate).select("key", "source", F.col("start_position").alias("s")))
query("plan_round_trip", SQL["cmp_overlap"])(
    lambda s, d: seg(compare.Comparison(windows(s, d), plans.Plan.from_json(plan(horizon=horizon(s, d)).to_json())).overlap(), F.col("target_n").alias("tn"), F.col("against_n").alias("an"), "finality"))

# ------------------------------------------------------------------ histories, recording

query("qry_open_closed", W + " select case when e is null then 'open' else 'closed' end as state, count(*) as n, min(s) as first, max(s) as last from w group by all")(
    lambda s, d: (lambda q: q.closed().withColumn("state", F.lit("closed")).unionByName(q.open().withColumn("state", F.lit("open"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("start_position").alias("first"), F.max("start_position").alias("last")))(history.Query(windows(s, d))))
query("qry_windows_at", W + f""" select 'open' as state, key, source, s, {K}::bigint as e from w where s <= {K} and (e is null or e > {K}) union all select 'closed', key, source, s, e from w where e <= {K}
  union all select * from (select 'latest', key, source, s, least(coalesce(e, {K}), {K}) from w where s <= {K} order by key desc, source desc, part desc, s desc limit 1)""")(
    lambda s, d: (lambda q: q.open_at(K).withColumn("state", F.lit("open")).unionByName(q.closed_at(K).withColumn("state", F.lit("closed"))).unionByName(q.latest_at(K).withColumn("state", F.lit("latest"))).select(
        "state", "key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e")))(history.Query(windows(s, d))))
query("qry_snapshot_time", W + f""" select key, source, s, least(coalesce(epoch_us(e_ts) * 10, {T0}), {T0}) as end_m, case when epoch_us(e_ts) * 10 <= {T0} then 'Final' else 'Provisional' end as finality from w where epoch_us(st_ts) * 10 <= {T0}""")(
    lambda s, d: history.snapshot_at(windows(s, d), T0, "timestamp").select("key", "source", F.col("start_position").alias("s"), "end_m", "finality"))
query("rec_trimmed", W + f" select key, source, s from w where e is null or e > {K}")(lambda s, d: record.trim_closed_before(windows(s, d), K).select("key", "source", F.col("start_position").alias("s")))
query("rec_families", "with " + BASE + win("w") + "," + win("z", "event_type = 'error'") + " select 'HighValue' as family, key, source, s, e from w union all select 'Error', key, source, s, e from z")(
    lambda s, d: families(s, d).where("window_name in ('HighValue', 'Error')").select(F.col("window_name").alias("family"), "key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e")))
query("rec_boundary_changes", "with " + BASE + win(seg=True) + " select key, source, s, e, 'phase' as segment_name, ctx as previous, nxt as current from w where nxt is not null")(
    lambda s, d: windows(s, d, segmented=True).select("key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e"), F.explode("boundary_changes").alias("c")).select("key", "source", "s", "e", "c.*"))
query("rec_out_of_order", "with " + BASE + """ o as (select key, source, pos - case when pos % 7 = 0 then 60 else 0 end as p, pos from ev)
select key, source, p as pos, case when p < 0 then 'NegativePosition' when p <= max(p) over (partition by key, source order by pos rows between unbounded preceding and 1 preceding) then 'OutOfOrder' end as rejected from o""")(
    lambda s, d: record.admitted(obs(s, d).withColumn("arrival", F.col("pos")).withColumn("pos", F.col("pos") - F.when(F.col("pos") % 7 == 0, 60).otherwise(0)), "arrival").select("key", "source", "pos", "rejected"))
query("rec_hysteresis", "with " + BASE.replace("value > 20 as active", "value") + """ f as (select *, coalesce(last_value(case when value > 50 then true when value < 10 then false end ignore nulls) over (partition by key, source order by pos), false) as on_ from ev),
c as (select *, lag(on_, 1, false) over (partition by key, source order by pos) as was from f), d as (select * from c where on_ <> was)
select key, source, s, e from (select key, source, pos as s, lead(pos) over (partition by key, source order by pos) as e, on_ from d) where on_""")(
    lambda s, d: record.record(record.stabilise_two(_two(s, d), "enter", "leave")).select("key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e")))


def _two(s, d):
    """Observations with both predicates."""
    return events(s, d).select(*record.observed(POS(), definition()), (F.col("value") > 50).alias("enter"), (F.col("value") < 10).alias("leave"))


query("tmp_ranges", W + f" select rid, s <= {K} and {K} < coalesce(e, {H}) as holds, s = e as empty, coalesce(e, {H}) - s as length, s < 6000 and 5500 < coalesce(e, {H}) as meets from r")(
    lambda s, d: windows(s, d).withColumn("e", F.coalesce("end_position", F.lit(horizon(s, d)))).withColumn("lo", F.lit(5500)).withColumn("hi", F.lit(6000)).select(
        F.col("record_id").alias("rid"), temporal.contains("start_position", "e", F.lit(K)).alias("holds"), temporal.is_empty("start_position", "end_position").alias("empty"), temporal.saturating_subtract("e", "start_position").alias("length"),
        temporal.overlaps("start_position", "e", "lo", "hi").alias("meets")))

# ------------------------------------------------------------------ totals, matrix

NINE = A1 + """, y as (select 'overlap' as family, e - s as m from x where tn > 0 and an > 0 union all select 'residual', e - s from x where tn > 0 and an = 0 union all select 'missing', e - s from x where tn = 0 and an > 0
  union all select 'coverage', e - s from x where tn > 0 union all select 'gap', nxt - e from (select *, lead(s) over (partition by key, part order by s) as nxt from x) where nxt > e
  union all select 'symmetric-difference', e - s from x where (tn > 0) <> (an > 0)
  union all select 'containment', e - s from x where tn > 0 and an > 0 union all select 'containment', x.e - x.s from x join t on t.key = x.key and t.part = x.part and t.a <= x.s and t.b >= x.e where tn > 0 and an = 0)"""
query("cmp_all_totals", NINE + " select family, count(*) as row_count, sum(m)::bigint as total_length from y group by family")(
    lambda s, d: (lambda c: _union([c.totals(n).withColumn("family", F.lit(n)) for n in plans.SIMPLE]))(comp(s, d)))
MORE = ("lead-lag:Start:ProcessingPosition:50", "asof:Nearest:ProcessingPosition:50")
query("cmp_all_counts", NINE + f""" select family, count(*) as rows from y group by family union all select unnest(['{MORE[0]}', '{MORE[1]}']), (select count(*) from t)""")(
    lambda s, d: _union([r.agg(F.count(F.lit(1)).alias("rows")).withColumn("family", F.lit(n)) for n, r in compare.Comparison(windows(s, d), replace(plan(horizon=horizon(s, d)), comparators=(*plans.SIMPLE, *MORE))).run().items()]))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


query("matrix_cell", "select * from (" + PAIRS + ") where target = 'lane-b' and against = 'lane-c'")(
    lambda s, d: compare.matrix_cell(compare.source_matrix(windows(s, d).where("end_position is not null"), "HighValue", LANES[:3]), "lane-b", "lane-c").select(
        "target", "against", "overlap_rows", "residual_rows", "missing_rows", "coverage_rows", F.round("coverage_ratio", 9).alias("coverage_ratio")))
query("hierarchy_warnings", W + " select 'MissingLineage' as code, 'childWindowName' as path union all select 'HierarchyOpenWindowsWithoutHorizon', 'windowNames' from w where e is null having count(*) > 0")(
    lambda s, d: compare.hierarchy_diagnostics(families(s, d), "HighValue", "Nothing"))
query("hierarchy_one_sweep", HIER)(lambda s, d: compare.hierarchy(families(s, d), "HighValue", "Error", bin_width=None).select("source", F.col("partition_id").alias("part"), F.col("start_m").alias("s"), F.col("end_m").alias("e"), "kind"))


def _counted(s, d, comparators, *rules):
    """Violations of each rule over a plan of these comparators."""
    c = compare.Comparison(windows(s, d), replace(plan(horizon=horizon(s, d)), comparators=comparators))
    return governance.assess(c, list(rules)).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


query("asm_rules", A1 + f""", rs as (select 'single' as rule, count(*) as violations from x where tn > 0 and an = 0 and e - s > 300 union all select 'total', count(*) from (select sum(e - s) as m from x where tn > 0 and an = 0) where m > 10
  union all select 'gaps', count(*) from (select *, lead(s) over (partition by key, part order by s) as nxt from x) where nxt - e > 300
  union all select 'final', (select count(*) from x where tn > 0 and an > 0 and tp + ap > 0) + (select count(*) from x where tn > 0 and an = 0 and tp > 0)
    + (select count(*) from (select *, lead(s) over w as nxt, lead(tp + ap) over w as np from x window w as (partition by key, part order by s)) where nxt > e and greatest(tp + ap, np) > 0)
) select * from rs where violations > 0""")(
    lambda s, d: _counted(s, d, ("overlap", "residual", "gap"), governance.Rule("single", "maximum_residual", 300), governance.Rule("total", "maximum_residual", 10, "Total"), governance.Rule("gaps", "maximum_gap", 300), governance.Rule("final", "require_final")))
query("asm_lead_lag", NEAR.format(p="a") + " select 'lag' as rule, count(*) as violations from l where delta is null or abs(delta) > 50 having count(*) > 0")(
    lambda s, d: _counted(s, d, ("lead-lag:Start:position:9",), governance.Rule("lag", "maximum_lead_lag", 50), governance.Rule("not declared", "minimum_coverage", 1)))
query("asm_diagnostics", W + """ select 'codes' as rule, 'OpenWindowsWithoutPolicy' as evidence from w where e is null and source in ('lane-a', 'lane-b') having count(*) > 0""")(
    lambda s, d: governance.assess(compare.Comparison(windows(s, d), plan()), [governance.Rule("codes", "allowed_diagnostics", codes=("BroadSelector",))]))
query("live_unseen_lanes", f"""with x as (select cast(user_id as varchar) as lane, event_id + 1 as pos from events union all select cast(c_custkey as varchar), 0 from customer),
  y as (select *, lead(pos) over (partition by lane order by pos) as nxt from x) select lane, pos + 500 as silent_at, nxt as alive_at from y where coalesce(nxt, (select max(event_id) + 1001 from events)) - pos >= 500""")(
    lambda s, d: live.silences(obs(s, d).select(F.col("key").alias("lane"), "pos"), 500, horizon(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("lane"))))

# ------------------------------------------------------------------ roll-ups

#: Parents' windows of child observations in {{src}} (pos, child, source, part, active, scope): running sums of what children bring and take away.
ROLL = """m as (select *, lag(scope) over l as was_scope, lag(active) over l as was from ({src}) window l as (partition by child, source, part order by pos)),
dl as (select pos, source, part, was_scope as scope, 0 as seq, -(was::int) as da, -1 as dt from m where was_scope is not null and was_scope <> scope
  union all select pos, source, part, scope, 1, active::int - case when was_scope = scope then was::int else 0 end, case when was_scope = scope then 0 else 1 end from m),
rs as (select *, sum(da) over o as a, sum(dt) over o as t from dl window o as (partition by scope, source, part order by pos, seq)),
ro as (select pos, source, part, scope, ({rule}) as active from rs)"""
OUT = """, tr as (select *, lag(active, 1, false) over (partition by scope, source, part order by pos) as before from ro), ch as (select * from tr where active <> before),
en as (select scope, source, part, pos as s, lead(pos) over (partition by scope, source, part order by pos) as e, active from ch)"""
query("rup_move", "with " + BASE + ROLL.format(src="select pos, key as child, source, part, active, cast(pos % 7 as varchar) as scope from ev", rule="a > 0") + OUT + " select scope as key, source, part, s, e from en where active")(
    lambda s, d: record.roll_up(obs(s, d), "Parent", F.col("pos") % 7, record.any_active).select(*WCOLS()))
query("rup_segments", "with " + BASE + ROLL.format(src="select pos, key as child, source, part, active, (user_id % 10) || '/' || case when active then phase else '' end as scope from ev", rule="a > 0") + OUT
      + " select split_part(scope, '/', 1) as key, source, part, s, e, nullif(split_part(scope, '/', 2), '') as era from en where active")(
    lambda s, d: record.roll_up(record.project_segments(obs(s, d, segmented=True), rename={"phase": "era"}), "Parent", F.col("key").cast("long") % 10, record.any_active, segments=True).select(*WCOLS(), F.filter("segments", lambda x: x["name"] == "era")[0]["value"].alias("era")))
query("rup_transform", "with " + BASE + ROLL.format(src="select pos, key as child, source, part, active, (user_id % 10) || '/' || case when active then upper(phase) else '' end as scope from ev", rule="t > 0 and a = t") + OUT
      + " select split_part(scope, '/', 1) as key, source, part, s, e, nullif(split_part(scope, '/', 2), '') as phase from en where active")(
    lambda s, d: record.roll_up(record.project_segments(obs(s, d, segmented=True), keep=["phase"], transform={"phase": F.upper}), "Parent", F.col("key").cast("long") % 10, record.all_active, segments=True).select(*WCOLS(), F.filter("segments", lambda x: x["name"] == "phase")[0]["value"].alias("phase")))
SQL["rup_multilevel"] = ("with " + BASE + ROLL.format(src="select pos, key as child, source, part, active, cast(user_id % 10 as varchar) as scope from ev", rule="a > 0").replace("m as", "m1 as", 1).replace("from m ", "from m1 ").replace("from m)", "from m1)").replace("dl as", "dl1 as").replace("from dl ", "from dl1 ").replace("rs as", "rs1 as").replace("from rs)", "from rs1)").replace("ro as", "ro1 as") + ", "
                         + ROLL.format(src="select pos, scope as child, source, part, active, cast(cast(scope as int) % 3 as varchar) as scope from ro1", rule="a > 0") + OUT + " select scope as key, source, part, s, e from en where active")

# ------------------------------------------------------------------ episodes

LIVE = EPI.replace("from r where e is not null)", f"from (select key, part, source, rid, s, coalesce(e, {H}) as e, e is null as prov from r))").replace("from fr group by all)", "from fr group by key, source, episode_id)")
query("epi_live", LIVE + f", fn as (select episode_id, bool_or(prov) or max(e) + {TOL} >= {H} as prov from fr group by all) select key, source, ep.episode_id, s, e, fragments, {FINAL.format('prov')} as finality from ep join fn using (episode_id)")(
    lambda s, d: episodes.form(windows(s, d), TOL, horizon(s, d)).select("key", "source", "episode_id", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "fragments", "finality"))
query("epi_identity", EPI + " select episode_id, sha256(string_agg(s || ' ' || e || ' ' || rid, chr(10) order by s, e, rid)) as identity from fr group by episode_id")(
    lambda s, d: episodes.form(windows(s, d), TOL).select("episode_id", "identity"))
RELS = SQL["epi_relations"].rsplit(" select ", 1)[0]
RELL = RELS.replace("from r where e is not null)", f"from (select key, part, source, rid, s, coalesce(e, {H}) as e, e is null as prov from r))").replace("from fr group by all)", "from fr group by key, source, episode_id)")
query("epi_finality", RELL + f""", fn as (select coalesce(c, rel.episode_id) as c, bool_or(fr.prov) or max(fr.e) + {TOL} >= {H} or max(fr.e) + 10 >= {H} as prov from rel join fr using (episode_id) group by 1)
select episode_id, kind, {FINAL.format('prov')} as finality from rel join fn on fn.c = coalesce(rel.c, rel.episode_id)""")(
    lambda s, d: episodes.relations(windows(s, d), "lane-a", "lane-b", TOL, 10, horizon(s, d)).select("episode_id", "kind", "finality"))
METRIC = SQL["epi_metrics"].rsplit("\nselect kind", 1)[0]
query("epi_summary", METRIC + """, z as (select *, coalesce(overlap, 0) as ov2 from tl left join ov using (c)),
ag as (select count(*) filter (kind = 'OneToOne') as one_to_one, count(*) filter (kind = 'Split') as splits, count(*) filter (kind = 'Merge') as merges, count(*) filter (kind = 'Complex') as complex, sum(ov2)::bigint as overlap,
  sum(target_active) as ta, sum(against_active) as aa, median(os - ts) filter (kind = 'OneToOne')::double as onset_median, max(against_active - target_active) filter (kind = 'OneToOne') as active_max from z),
c as (select count(*) filter (side = 'Target') as tn, count(*) filter (side = 'Against') as an, count(*) filter (side = 'Target' and kind not like 'Unmatched%') as tm, count(*) filter (side = 'Against' and kind not like 'Unmatched%') as am,
  count(*) filter (side = 'Target' and kind = 'Split') as sp from rel)
select tn as target_episodes, an as against_episodes, tm as matched_target, am as matched_against, one_to_one, splits, merges, complex, overlap, an - tn as count_bias, (aa - ta)::bigint as active_bias, round(tm / tn, 9) as target_match_rate, round(sp / tn, 9) as split_rate,
  round(overlap / ta, 9) as target_coverage, round(overlap / (ta + aa - overlap), 9) as iou, onset_median, active_max::bigint as active_max from c, ag""")(
    lambda s, d: episodes.comparison_summary(rel(s, d), episodes.metrics(windows(s, d), "lane-a", "lane-b", TOL, 10)).select(
        "target_episodes", "against_episodes", "matched_target", "matched_against", "one_to_one", "splits", "merges", "complex", "overlap", "count_bias", "active_bias", *[F.round(c, 9).alias(c) for c in ("target_match_rate", "split_rate", "target_coverage", "iou")], "onset_median", "active_max"))
query("epi_of_kind", RELS + " select episode_id, kind from rel where kind = 'Split' or kind = 'UnmatchedTarget'")(
    lambda s, d: (lambda r: episodes.of_kind(r, "Split").unionByName(episodes.of_kind(r, "UnmatchedTarget")).select("episode_id", "kind"))(rel(s, d)))


def _portable(s, d):
    return episodes.portable(windows(s, d).where("end_position is not null"), "lane-a", "lane-b", TOL, 10)


INDEXED = """ix as (select *, case when source = 'lane-a' then 'Target' else 'Against' end as side, row_number() over (partition by source order by key, s, e) - 1 as idx from ep where source in ('lane-a', 'lane-b'))"""
query("epi_portable_episodes", EPI + "," + INDEXED + " select side, idx, key, s, e, fragments, active from ix")(
    lambda s, d: _portable(s, d)[0].select("side", F.col("index").alias("idx"), "key", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "fragments", "active"))
query("epi_portable_relations", REL + "," + INDEXED + """ select any_value(kind) as kind, coalesce(string_agg(idx, ',' order by idx) filter (rel.side = 'Target'), '') as target, coalesce(string_agg(idx, ',' order by idx) filter (rel.side = 'Against'), '') as against
  from rel join ix using (episode_id) group by coalesce(c, rel.episode_id)""")(
    lambda s, d: _portable(s, d)[1].select("kind", F.array_join(F.col("target").cast("array<string>"), ",").alias("target"), F.array_join(F.col("against").cast("array<string>"), ",").alias("against")))
