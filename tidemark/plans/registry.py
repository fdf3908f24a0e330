"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import compare, episodes, governance, history, record
from tidemark.plans import comparison as plans
from tidemark.streaming import live

H = "(select max(pos) + 1000 from ev)"  # in SQL: beyond the last position of the table
K = 5_000


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def definition(name="HighValue", active=None, segmented=False):
    k = F.get_json_object("props", "$.k").cast("int")
    lane = F.concat(F.lit("lane-"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), k % 3 + 1))
    phase = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "early").otherwise("late")
    return record.WindowDefinition(name, F.col("value") > 20 if active is None else active, F.col("user_id"), lane, F.col("user_id") % 4, {"phase": phase} if segmented else {}, {}, {"type": F.col("event_type")}, F.col("ts"))


def horizon(spark, d) -> int:
    """A position beyond the last of the table."""
    return (events(spark, d).agg(F.max("event_id")).first()[0] or 0) + 1001


def POS():
    return F.col("event_id") + 1


def obs(spark, d, **kw):
    return record.observe(events(spark, d), POS(), definition(**kw))


def windows(spark, d, **kw):
    return record.record(obs(spark, d, **kw))


BASE = """
ev as (select event_id + 1 as pos, cast(user_id as varchar) as key, user_id, 'lane-' || (['a', 'b', 'c'])[(cast(json_extract(props, '$.k') as int) % 3) + 1] as source, cast(user_id % 4 as varchar) as part,
  value > 20 as active, case when ts < timestamp '2024-01-16' then 'early' else 'late' end as phase, event_type as tag, ts, event_type from events),
"""


def win(name="w", active="active", seg=False):
    seg_s = "phase" if seg else "''"
    return f"""
{name}_l as (select *, ({active}) as act, {seg_s} as ctx from ev),
{name}_c as (select *, lag(case when act then ctx end) over (partition by key, source order by pos) as was, case when act then ctx end as st from {name}_l),
{name}_d as (select * from {name}_c where st is distinct from was),
{name} as (select * from (select key, source, part, pos as s, lead(pos) over l as e, ts as st_ts, lead(ts) over l as e_ts, phase, tag, act, ctx, lead(st) over l as nxt from {name}_d window l as (partition by key, source order by pos)) where act)
"""


RID = "'HighValue|' || key || '|' || source || '|' || part || '|' || s"
W = "with " + BASE + win() + f", r as (select *, {RID} as rid from w)"
CLIP = f", n as (select key, part, source, rid, s as a, coalesce(e, {H}) as b, e is null as prov from r)"
#: Elementary segments of lane-a (target) and the against side, by a join of ranges.
ALIGN = """, t as (select * from n where source = 'lane-a'), g as (select * from n where source in ({against})),
pts as (select distinct key, part, p from (select key, part, unnest([a, b]) as p from t union all select key, part, unnest([a, b]) as p from g)),
sg as (select * from (select key, part, p as s, lead(p) over (partition by key, part order by p) as e from pts) where e is not null),
al as (select sg.key, sg.part, sg.s, sg.e, (select count(*) from t where t.key = sg.key and t.part = sg.part and t.a <= sg.s and t.b >= sg.e) as tn,
  (select count(*) from t where t.key = sg.key and t.part = sg.part and t.a <= sg.s and t.b >= sg.e and prov) as tp,
  (select count(*) from g where g.key = sg.key and g.part = sg.part and g.a <= sg.s and g.b >= sg.e) as an,
  (select count(*) from g where g.key = sg.key and g.part = sg.part and g.a <= sg.s and g.b >= sg.e and prov) as ap,
  (select count(distinct source) from g where g.key = sg.key and g.part = sg.part and g.a <= sg.s and g.b >= sg.e) as src from sg),
x as (select * from al where tn > 0 or an > 0)"""
A1 = W + CLIP + ALIGN.format(against="'lane-b'")
A2 = W + CLIP + ALIGN.format(against="'lane-b', 'lane-c'")
FIN = "case when {} then 'Provisional' else 'Final' end as finality"


def plan(against=None, **kw):
    kw = {"scope_window": "HighValue", "use_segments": False} | kw
    return plans.Plan("lanes", plans.for_source("lane-a"), (against or plans.for_source("lane-b"),), plans.SIMPLE, **kw)


def comp(spark, d, against=None, **kw):
    return compare.Comparison(windows(spark, d), plan(against, **({"horizon": horizon(spark, d)} | kw)))


def seg(df, *more):
    """Scope and range columns under the names of the SQL."""
    base = {"key": "key", "partition_id": "part", "start_m": "s", "end_m": "e"}
    return df.select(*[F.col(k).alias(v) for k, v in base.items() if k in df.columns], *more)


QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def WCOLS():
    return ["key", "source", F.col("partition_id").alias("part"), F.col("start_position").alias("s"), F.col("end_position").alias("e")]



query("rec_windows", W + " select key, source, part, s, e, tag from w")(lambda s, d: windows(s, d).select(*WCOLS(), F.col("tags")[0]["value"].alias("tag")))
query("rec_windows_segmented", "with " + BASE + win(seg=True) + " select key, source, part, s, e, ctx as phase, case when e is null then null when nxt is null then 'ActivePredicateEnded' else 'SegmentChanged' end as reason from w")(
    lambda s, d: windows(s, d, segmented=True).select(*WCOLS(), F.col("segments")[0]["value"].alias("phase"), F.col("boundary_reason").alias("reason")))
query("rec_windows_event_time", W + " select key, source, s, epoch_us(st_ts) as start_us, epoch_us(e_ts) as end_us from w")(
    lambda s, d: windows(s, d).select("key", "source", F.col("start_position").alias("s"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us")))
query("rec_transitions", W + " select key, source, pos, kind from (select key, source, s as pos, 'Opened' as kind from w union all select key, source, e, 'Closed' from w where e is not null)")(
    lambda s, d: record.transitions(windows(s, d)).select("key", "source", F.col("position").alias("pos"), "kind"))
query("rec_debounced", "with " + BASE.replace("value > 20 as active", "value > 20 as raw") + """
q as (select *, sum(ch) over (partition by key, source order by pos) as run from (select *, case when raw is not distinct from lag(raw) over (partition by key, source order by pos) then 0 else 1 end as ch from ev)),
k as (select *, row_number() over (partition by key, source, run order by pos) as nth from q),
f as (select *, coalesce(last_value(case when raw and nth = 2 then true when not raw and nth = 2 then false end ignore nulls) over (partition by key, source order by pos rows between unbounded preceding and current row), false) as on_ from k),
c as (select *, lag(on_, 1, false) over (partition by key, source order by pos) as was from f), d as (select * from c where on_ <> was)
select key, source, s, e from (select key, source, pos as s, lead(pos) over (partition by key, source order by pos) as e, on_ from d) where on_""")(
    lambda s, d: record.record(record.stabilise(obs(s, d), 2, 2)).select("key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e")))
query("qry_filter_tag", W + " select key, source, s from w where tag = 'click' and source = 'lane-a'")(lambda s, d: history.Query(windows(s, d)).tag("type", "click").source("lane-a").windows().select("key", "source", F.col("start_position").alias("s")))
query("qry_snapshot", W + f" select key, source, s, least(coalesce(e, {K}), {K}) as e, case when e <= {K} then 'Final' else 'Provisional' end as finality from w where s <= {K}")(
    lambda s, d: history.snapshot_at(windows(s, d), K).select("key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e"), "finality"))
query("qry_latest", W + " select key, source, s from w order by key desc, source desc, part desc, s desc limit 1")(lambda s, d: history.Query(windows(s, d)).latest().select("key", "source", F.col("start_position").alias("s")))
query("qry_overlaps", W + """ select p.key as key, p.rid as first_id, q.rid as second_id, greatest(p.s, q.s) as s, least(p.e, q.e) as e from r p join r q on p.key = q.key and p.part = q.part
  where p.e is not null and q.e is not null and p.s < q.e and q.s < p.e and (p.s, p.e, p.rid) < (q.s, q.e, q.rid)""")(
    lambda s, d: history.find_overlaps(windows(s, d)).select("key", F.col("first_record_id").alias("first_id"), F.col("second_record_id").alias("second_id"), F.col("overlap_start").alias("s"), F.col("overlap_end").alias("e")))
QUERIES["qry_overlaps_binned"] = lambda s, d: history.find_overlaps(windows(s, d), 500).select("key", F.col("first_record_id").alias("first_id"), F.col("second_record_id").alias("second_id"), F.col("overlap_start").alias("s"), F.col("overlap_end").alias("e"))
SQL["qry_overlaps_binned"] = SQL["qry_overlaps"]
query("qry_residuals", W + """, c as (select * from r where e is not null), o as (select * from c where source <> 'lane-a'), t as (select * from c where source = 'lane-a'),
b as (select rid, key, part, s as ts, e as te, unnest(list_distinct(list_concat([s, e], coalesce((select list(least(greatest(p, t.s), t.e)) from (select unnest([o.s, o.e]) as p from o where o.key = t.key and o.part = t.part and o.s < t.e and t.s < o.e)), [])))) as p from t),
g as (select *, lead(p) over (partition by rid order by p) as q from b), f as (select * from g where q is not null and not exists (select 1 from o where o.key = g.key and o.part = g.part and o.s <= g.p and o.e >= g.q)),
m as (select *, sum(case when p = lq then 0 else 1 end) over (partition by rid order by p) as island from (select *, lag(q) over (partition by rid order by p) as lq from f))
select key, rid, min(p) as s, max(q) as e from m group by key, rid, island""")(
    lambda s, d: history.find_residuals(windows(s, d), "lane-a").select("key", F.col("record_id").alias("rid"), F.col("start_position").alias("s"), F.col("end_position").alias("e")))
SUMM = "count(*) as record_count, count(*) filter (e is not null) as final_count, count(*) filter (e is null) as provisional_count, count(e) as measured_count, coalesce(sum(e - s), 0)::bigint as total_length"
query("qry_summarize_segment", "with " + BASE + win(seg=True) + f" select ctx as value, {SUMM} from w group by ctx")(lambda s, d: history.summarise(windows(s, d, segmented=True), "segments", "phase"))
query("qry_summarize_tag", W + f" select tag as value, {SUMM} from w group by tag")(lambda s, d: history.summarise(windows(s, d), "tags", "type"))
query("qry_annotations", W + f" select rid, name, revision, s as known_at from (select rid, s, name, row_number() over (partition by rid, name order by s) as revision from r, (values ('note'), ('review')) v(name)) where s <= {K}")(
    lambda s, d: history.annotations_known_at(windows(s, d).select(F.col("record_id").alias("target"), F.explode(F.array(F.lit("note"), F.lit("review"))).alias("name"), F.col("start_position").alias("known_at"), F.col("start_position").alias("seq")), K).select(F.col("target").alias("rid"), "name", "revision", "known_at"))
query("nrm_clip", W + CLIP + " select key, rid, a, b, prov from n where source in ('lane-a', 'lane-b')")(
    lambda s, d: comp(s, d).norm.select("key", F.col("record_id").alias("rid"), F.col("start_m").alias("a"), F.col("end_m").alias("b"), (F.col("end_status") == "OpenAtHorizon").alias("prov")))
query("nrm_known_at", W + f" select key, rid, s as a, least(coalesce(e, {K}), {K}) as b, e is null or e > {K} as prov from r where s <= {K} and source in ('lane-a', 'lane-b')")(
    lambda s, d: comp(s, d, known_at=K, horizon=None).norm.select("key", F.col("record_id").alias("rid"), F.col("start_m").alias("a"), F.col("end_m").alias("b"), (F.col("end_status") == "OpenAtHorizon").alias("prov")))
query("nrm_coalesce", "with " + BASE + win(seg=True) + """, c as (select key, part, source, s, e, case when s = lag(e) over (partition by key, source order by s) then 0 else 1 end as new from w where e is not null and source in ('lane-a', 'lane-b')),
g as (select *, sum(new) over (partition by key, source order by s) as island from c) select key, source, min(s) as a, max(e) as b from g group by key, source, island""")(
    lambda s, d: compare.Comparison(windows(s, d, segmented=True).where("end_position is not null"), plan(horizon=None, coalesce=True)).norm.select("key", "source", F.col("start_m").alias("a"), F.col("end_m").alias("b")))
query("aln_segments", A1 + """ select x.key, x.s, x.e, coalesce((select string_agg(rid, ',' order by rid) from t where t.key = x.key and t.part = x.part and t.a <= x.s and t.b >= x.e), '') as target_ids,
  coalesce((select string_agg(rid, ',' order by rid) from g where g.key = x.key and g.part = x.part and g.a <= x.s and g.b >= x.e), '') as against_ids from x""")(
    lambda s, d: compare.align_lineage(comp(s, d).norm).select("key", F.col("start_m").alias("s"), F.col("end_m").alias("e"), F.array_join("target_ids", ",").alias("target_ids"), F.array_join("against_ids", ",").alias("against_ids")))
query("aln_counts", A1 + " select key, part, s, e, tn::bigint as tn, an::bigint as an from x")(lambda s, d: seg(comp(s, d).aligned, F.col("target_n").alias("tn"), F.col("against_n").alias("an")))
query("cmp_overlap", A1 + " select key, part, s, e, tn, an, " + FIN.format("tp + ap > 0") + " from x where tn > 0 and an > 0")(lambda s, d: seg(comp(s, d).overlap(), F.col("target_n").alias("tn"), F.col("against_n").alias("an"), "finality"))
query("cmp_residual", A1 + " select key, part, s, e, " + FIN.format("tp > 0") + " from x where tn > 0 and an = 0")(lambda s, d: seg(comp(s, d).residual(), "finality"))
query("cmp_missing", A1 + " select key, part, s, e, " + FIN.format("ap > 0") + " from x where tn = 0 and an > 0")(lambda s, d: seg(comp(s, d).missing(), "finality"))
query("cmp_coverage", A1 + " select key, part, s, e, e - s as target_magnitude, case when an > 0 then e - s else 0 end as covered_magnitude from x where tn > 0")(lambda s, d: seg(comp(s, d).coverage(), "target_magnitude", "covered_magnitude"))
query("cmp_coverage_summary", A1 + " select key, part, sum(e - s)::bigint as target_magnitude, sum(case when an > 0 then e - s else 0 end)::bigint as covered_magnitude, round(sum(case when an > 0 then e - s else 0 end) / sum(e - s), 9) as ratio from x where tn > 0 group by key, part")(
    lambda s, d: seg(comp(s, d).coverage_summary(), "target_magnitude", "covered_magnitude", F.round("ratio", 9).alias("ratio")))
query("cmp_gap", A1 + " select key, part, e as s, nxt as e from (select *, lead(s) over (partition by key, part order by s) as nxt from x) where nxt > e")(lambda s, d: seg(comp(s, d).gap()))
query("cmp_symdiff", A1 + " select key, part, s, e, case when tn > 0 then 'Target' else 'Against' end as side from x where (tn > 0) <> (an > 0)")(lambda s, d: seg(comp(s, d).symmetric_difference(), "side"))
query("cmp_containment", A1 + """ select key, s, e, 'Contained' as status, cast(null as varchar) as rid from x where tn > 0 and an > 0
  union all select x.key, x.s, x.e, case when x.s = t.a then 'LeftOverhang' when x.e = t.b then 'RightOverhang' else 'NotContained' end, t.rid from x join t on t.key = x.key and t.part = x.part and t.a <= x.s and t.b >= x.e where tn > 0 and an = 0""")(
    lambda s, d: comp(s, d).containment().select("key", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "status", F.col("record_id").alias("rid")))
query("cmp_totals", A1 + " select 'overlap' as family, count(*) as row_count, sum(e - s)::bigint as total_length from x where tn > 0 and an > 0 union all select 'residual', count(*), sum(e - s)::bigint from x where tn > 0 and an = 0")(
    lambda s, d: (lambda c: c.totals("overlap").withColumn("family", F.lit("overlap")).unionByName(c.totals("residual").withColumn("family", F.lit("residual"))))(comp(s, d)))

NEAR = W + CLIP + """, t as (select * from n where source = 'lane-a'), g as (select * from n where source = 'lane-b'),
j as (select t.rid, t.key, t.{p} as tp, g.{p} as gp, g.rid as gid, abs(t.{p} - g.{p}) as dist from t left join g on g.key = t.key and g.part = t.part),
m as (select *, row_number() over (partition by rid order by dist, gid) as rn, count(*) over (partition by rid, dist) as ties from j),
l as (select key, rid, tp - gp as delta, gid as against_id, case when gp is null then 'MissingComparison' when tp < gp then 'TargetLeads' when tp > gp then 'TargetLags' else 'Equal' end as direction, gp is not null and dist <= 50 as within_tolerance from m where rn = 1)
"""


def LL():
    return ["key", F.col("record_id").alias("rid"), "delta", "against_id", "direction", "within_tolerance"]



query("cmp_leadlag_start", NEAR.format(p="a") + " select * from l")(lambda s, d: comp(s, d).lead_lag("Start", 50).select(*LL()))
query("cmp_leadlag_end", NEAR.format(p="b") + " select * from l")(lambda s, d: comp(s, d).lead_lag("End", 50).select(*LL()))
query("cmp_leadlag_summary", NEAR.format(p="a") + """ select count(*) as row_count, count(*) filter (direction = 'TargetLeads') as leads, count(*) filter (direction = 'TargetLags') as lags, count(*) filter (direction = 'Equal') as equal,
  count(*) filter (direction = 'MissingComparison') as missing, count(*) filter (not within_tolerance and direction <> 'MissingComparison') as outside_tolerance, min(delta) as min_delta, max(delta) as max_delta from l""")(lambda s, d: comp(s, d).lead_lag_summary("Start", 50))
ASOF = W + CLIP + """, t as (select * from n where source = 'lane-a'), g as (select * from n where source = 'lane-b'),
j as (select t.rid, t.key, t.a as tp, g.a as gp, g.rid as gid, abs(t.a - g.a) as dist from t left join g on g.key = t.key and g.part = t.part),
c as (select *, row_number() over (partition by rid order by dist, gid) as rn, count(*) over (partition by rid, dist) as ties from j where gp is not null and {ok}),
fut as (select rid, min(dist) as fd from j where gp > tp group by rid),
b as (select t.rid, t.key, c.gp, c.gid, c.dist, c.ties, fut.fd from t left join c on c.rid = t.rid and c.rn = 1 left join fut on fut.rid = t.rid),
q as (select *, case when {future} and dist is null and fd is not null then 'FutureRejected' when dist is null or dist > 50 then 'NoMatch' when ties > 1 then 'Ambiguous' when dist = 0 then 'Exact' else 'Matched' end as status from b)
select key, rid, case when status in ('Exact', 'Matched', 'Ambiguous') then gid end as against_id, case when status = 'FutureRejected' then fd else dist end as distance, status from q"""
for _n, _ok, _f in (("Previous", "gp <= tp", "true"), ("Next", "gp >= tp", "false"), ("Nearest", "true", "false")):
    query(f"cmp_asof_{_n.lower()}", ASOF.format(ok=_ok, future=_f))(lambda s, d, _n=_n: comp(s, d).as_of(_n, 50).select("key", F.col("record_id").alias("rid"), "against_id", "distance", "status"))

for _a, _c, _r in (("any", None, "src >= 1"), ("all", None, "src = 2"), ("none", None, "src = 0"), ("at-least", 2, "src >= 2"), ("at-most", 1, "src <= 1"), ("exactly", 1, "src = 1")):
    query("cohort_" + _a.replace("-", "_"), A2 + f" select key, part, s, e, tn, src as active_sources, ({_r}) as active from x where tn > 0")(
        lambda s, d, _a=_a, _c=_c: (lambda c: seg(c.aligned.where("target_n > 0"), F.col("target_n").alias("tn"), "active_sources", c.active.alias("active")))(comp(s, d, plans.for_cohort(["lane-b", "lane-c"], _a, _c))))

MAT = W + """, c as (select * from r), has as (select source, count(*) as n, count(*) filter (e is null) as o from c group by source), grid as (select x.l as t, y.l as g from (values ('lane-a'), ('lane-b'), ('lane-c'), ('lane-z')) x(l), (values ('lane-a'), ('lane-b'), ('lane-c'), ('lane-z')) y(l))
select t as target, g as against, coalesce(h.n, 0) > 0 as target_has_windows, coalesce(k.n, 0) > 0 as against_has_windows, 0::bigint as overlap_rows, 0::bigint as residual_rows, 0::bigint as missing_rows, 0::bigint as coverage_rows, case when t = g and h.n > 0 then 1.0::double end as coverage_ratio from grid left join has h on h.source = t left join has k on k.source = g"""
LANES = ["lane-a", "lane-b", "lane-c", "lane-z"]
query("matrix_sources_blocked", MAT)(lambda s, d: compare.source_matrix(windows(s, d), "HighValue", LANES))
PAIRS = W + """, cl as (select * from r where e is not null), grid as (select x.l as tl, y.l as gl from (values ('lane-a'), ('lane-b'), ('lane-c')) x(l), (values ('lane-a'), ('lane-b'), ('lane-c')) y(l) where x.l <> y.l),
pt as (select distinct tl, gl, key, p from (select tl, gl, key, unnest([s, e]) as p from grid join cl on source = tl or source = gl)),
sg as (select * from (select *, lead(p) over (partition by tl, gl, key order by p) as q from pt) where q is not null),
z as (select sg.*, exists (select 1 from cl where cl.source = tl and cl.key = sg.key and cl.s <= p and cl.e >= q) as t, exists (select 1 from cl where cl.source = gl and cl.key = sg.key and cl.s <= p and cl.e >= q) as g from sg)
select tl as target, gl as against, count(*) filter (t and g) as overlap_rows, count(*) filter (t and not g) as residual_rows, count(*) filter (not t and g) as missing_rows, count(*) filter (t) as coverage_rows, round(sum(case when t and g then q - p else 0 end) / sum(case when t then q - p else 0 end), 9) as coverage_ratio from z group by tl, gl"""
query("matrix_sources", PAIRS)(lambda s, d: compare.source_matrix(windows(s, d).where("end_position is not null"), "HighValue", LANES[:3]).where("target <> against").select("target", "against", "overlap_rows", "residual_rows", "missing_rows", "coverage_rows", F.round("coverage_ratio", 9).alias("coverage_ratio")))


def families(s, d):
    return record.record_families(events(s, d), POS(), [definition(), definition("Error", F.col("event_type") == "error"), definition("Purchase", F.col("event_type") == "purchase"), definition("Signup", F.col("event_type") == "signup")])


HIER = "with " + BASE + win("w") + "," + win("z", "event_type = 'error'") + """, pa as (select * from w where e is not null), ch as (select * from z where e is not null),
pt as (select distinct source, part, p from (select source, part, unnest([s, e]) as p from pa union all select source, part, unnest([s, e]) from ch)),
sg as (select * from (select *, lead(p) over (partition by source, part order by p) as q from pt) where q is not null),
y as (select sg.*, exists (select 1 from pa where pa.source = sg.source and pa.part = sg.part and pa.s <= p and pa.e >= q) as hp, exists (select 1 from ch where ch.source = sg.source and ch.part = sg.part and ch.s <= p and ch.e >= q) as hc from sg)
select source, part, p as s, q as e, case when hp and hc then 'ParentExplained' when hp then 'UnexplainedParent' else 'OrphanChild' end as kind from y where hp or hc"""
query("hierarchy", HIER)(lambda s, d: compare.hierarchy(families(s, d), "HighValue", "Error").select("source", F.col("partition_id").alias("part"), F.col("start_m").alias("s"), F.col("end_m").alias("e"), "kind"))
query("fin_live_residual", A1.replace(f"coalesce(e, {H}) as b, e is null as prov from r", f"least(coalesce(e, {K}), {K}) as b, e is null or e > {K} as prov from r where s <= {K}") + " select key, part, s, e, " + FIN.format("tp > 0") + " from x where tn > 0 and an = 0")(
    lambda s, d: seg(comp(s, d, known_at=K, horizon=None).residual(), "finality"))

TOL = 100
EPI = W + f""", f as (select *, s - max(e) over (partition by key, source order by s, e, rid rows between unbounded preceding and 1 preceding) as gap from r where e is not null),
i as (select *, sum(case when gap <= {TOL} then 0 else 1 end) over (partition by key, source order by s, e, rid) as ep from f), fr as (select *, 'e:' || first_value(rid) over (partition by key, source, ep order by s, e, rid) as episode_id from i),
ep as (select key, source, episode_id, min(s) as s, max(e) as e, count(*) as fragments, sum(e - s)::bigint as active from fr group by all)"""
query("epi_form", EPI + " select *, e - s as elapsed, e - s - active as internal_gap from ep")(lambda s, d: episodes.form(windows(s, d), TOL).select("key", "source", "episode_id", F.col("start_m").alias("s"), F.col("end_m").alias("e"), "fragments", "active", "elapsed", "internal_gap"))
query("epi_set_summary", EPI + """ select count(*) as episodes, sum(fragments)::bigint as fragments, round(avg((fragments > 1)::int), 9) as multi_fragment_rate, max(fragments) as max_fragments, sum(e - s)::bigint as total_elapsed, round(avg(e - s), 6) as elapsed_mean, median(e - s)::double as elapsed_median, quantile_disc(e - s, 0.95) as elapsed_p95 from ep""")(
    lambda s, d: episodes.set_summary(episodes.form(windows(s, d), TOL)).select("episodes", "fragments", F.round("multi_fragment_rate", 9).alias("multi_fragment_rate"), "max_fragments", "total_elapsed", F.round("elapsed_mean", 6).alias("elapsed_mean"), "elapsed_median", "elapsed_p95"))
REL = EPI.replace("with ", "with recursive ", 1) + f""", ed as (select distinct t.episode_id as ti, a.episode_id as ai from fr t join fr a on t.key = a.key and t.part = a.part and t.source = 'lane-a' and a.source = 'lane-b' and t.s <= a.e + 10 and a.s <= t.e + 10),
bi as (select ti as x, ai as y from ed union select ai, ti from ed), reach as (select x, x as y from bi union select reach.x, bi.y from reach join bi on reach.y = bi.x),
cm as (select x, min(y) as c from reach group by x), sz as (select c, count(*) filter (x in (select ti from ed)) as tn, count(*) filter (x in (select ai from ed)) as an from cm group by c),
rel as (select e.episode_id, case when source = 'lane-a' then 'Target' else 'Against' end as side, case when c is null and source = 'lane-a' then 'UnmatchedTarget' when c is null then 'UnmatchedAgainst' when tn = 1 and an = 1 then 'OneToOne' when tn = 1 then 'Split' when an = 1 then 'Merge' else 'Complex' end as kind, c
  from ep e left join cm on cm.x = e.episode_id left join sz using (c) where source in ('lane-a', 'lane-b'))"""
rel = lambda s, d: episodes.relations(windows(s, d), "lane-a", "lane-b", TOL, 10)
query("epi_relations", REL + " select episode_id, side, kind from rel")(lambda s, d: rel(s, d).select("episode_id", "side", "kind"))
query("epi_metrics", REL + """, m as (select coalesce(c, rel.episode_id) as c, kind, source, s, e from fr join rel using (episode_id)),
tl as (select c, any_value(kind) as kind, sum(case when source = 'lane-a' then e - s else 0 end)::bigint as target_active, sum(case when source = 'lane-b' then e - s else 0 end)::bigint as against_active, min(case when source = 'lane-a' then s end) as ts, min(case when source = 'lane-b' then s end) as os from m group by c),
ov as (select t.c, sum(greatest(0, least(t.e, a.e) - greatest(t.s, a.s)))::bigint as overlap from m t join m a on t.c = a.c and t.source = 'lane-a' and a.source = 'lane-b' group by t.c)
select kind, target_active, against_active, coalesce(overlap, 0)::bigint as overlap, os - ts as onset_delta from tl left join ov using (c)""")(
    lambda s, d: episodes.metrics(windows(s, d), "lane-a", "lane-b", TOL, 10).select("kind", "target_active", "against_active", "overlap", "onset_delta"))
query("epi_scorecard", REL + """, c as (select count(*) filter (side = 'Target') as tn, count(*) filter (side = 'Target' and kind <> 'UnmatchedTarget') as tm, count(*) filter (side = 'Against') as an, count(*) filter (side = 'Against' and kind <> 'UnmatchedAgainst') as am from rel)
select tm as matched_target, am as matched_against, round(tm / tn, 9) as recall, round(am / an, 9) as precision, round(2 * (tm / tn) * (am / an) / (tm / tn + am / an), 9) as f1 from c""")(
    lambda s, d: episodes.scorecard(rel(s, d)).select("matched_target", "matched_against", *[F.round(x, 9).alias(x) for x in ("recall", "precision", "f1")]))

RUP = "with " + BASE + """ch as (select pos, key || '/' || source as child, cast(user_id % {m} as varchar) as parent, source, active, lag(active) over (partition by key, source order by pos) as was, row_number() over (partition by key, source order by pos) as nth from ev),
rn as (select parent, source, pos, sum(case when active then 1 else 0 end - case when coalesce(was, false) then 1 else 0 end) over w as a, sum(case when nth = 1 then 1 else 0 end) over w as t from ch window w as (partition by parent, source, part_ order by pos)),
st as (select parent, source, part_, pos, ({rule}) as act from rn), c as (select *, lag(act, 1, false) over (partition by parent, source, part_ order by pos) as pa from st), dd as (select * from c where act <> pa)
select parent as key, source, part_ as part, s, e from (select parent, source, part_, pos as s, lead(pos) over (partition by parent, source, part_ order by pos) as e, act from dd) where act"""
RUP = RUP.replace("source, active, lag", "source, part as part_, active, lag").replace("rn as (select parent, source, pos", "rn as (select parent, source, part_, pos")
query("rup_any", RUP.format(m=10, rule="a > 0"))(lambda s, d: record.roll_up(obs(s, d), "Parent", F.col("key").cast("long") % 10, record.any_active).select(*WCOLS()))
query("rup_all", RUP.format(m=10, rule="t > 0 and a = t"))(lambda s, d: record.roll_up(obs(s, d), "Parent", F.col("key").cast("long") % 10, record.all_active).select(*WCOLS()))
QUERIES["rup_multilevel"] = lambda s, d: record.roll_up(record.parent_observations(obs(s, d), "Parent", F.col("key").cast("long") % 10, record.any_active), "Region", F.col("key").cast("long") % 3, record.any_active).select(*WCOLS())

STEPS = ("Signup", "Purchase", "Error")


def candidates(n, name):
    """SQL: a lane's closed windows of a family as a list, in the order in which they are tried."""
    return f"""f{n} as (select key, source, part, list({{'s': s, 'e': e, 'id': '{name}|' || key || '|' || source || '|' || part || '|' || s}} order by e, s) as f{n} from {name}_w where e is not null group by key, source, part)"""


# One round for each first candidate of a lane: `used` are the ids that earlier chains took.
SEQ = "with recursive " + BASE + ",".join(win(f"{n}_w", f"event_type = '{n.lower()}'") for n in STEPS) + "," + ",".join(candidates(i, n) for i, n in enumerate(STEPS, 1)) + """,
lanes as (select * from f1 join f2 using (key, source, part) join f3 using (key, source, part)),
chain as (select key, source, part, 0 as i, [''] as used, f1[1] as a, f1[1] as b, f1[1] as c, false as found from lanes
  union all
  select key, source, part, n, case when c is null then used else list_concat(used, [b.id, c.id]) end, a, b, c, c is not null
  from (select *, ([x for x in f3 if not list_contains(used, x.id) and x.s >= b.s and x.s - b.e <= 2000])[1] as c
    from (select *, ([x for x in f2 if not list_contains(used, x.id) and x.s >= a.s and x.s - a.e <= 2000])[1] as b
      from (select key, source, part, i + 1 as n, used, f1[i + 1] as a, f2, f3 from chain join lanes using (key, source, part) where i < len(f1)))))
select key, source, part as partition_id, a.s as start_m, greatest(a.e, b.e, c.e) as end_m, greatest(a.e, b.e, c.e) - a.s as elapsed, greatest(0, b.s - a.e) + greatest(0, c.s - b.e) as total_gap,
  'Final' as finality, a.id || ',' || b.id || ',' || c.id as record_ids from chain where found"""
query("seq_three_step", SEQ)(lambda s, d: episodes.match_sequence(families(s, d).where("end_position is not null"), list(STEPS), 2000))

ROWS = W + f""", p as (select rid as row_id, case when e <= {K} then 'Final' else 'Provisional' end as finality from r where s <= {K}), q as (select rid as row_id, case when e <= 7500 then 'Final' else 'Provisional' end as finality from r where s <= 7500 and not (s % 97 = 0 and s <= {K}))"""
snap = lambda s, d, h, drop=False: history.snapshot_at(windows(s, d), h).where(f"not (start_position % 97 = 0 and start_position <= {K})" if drop else "true").select(F.col("record_id").alias("row_id"), "finality")
query("rev_changelog", ROWS + " select row_id, case when p.finality is null then 'Added' when q.finality is null then 'Retracted' else 'Revised' end as change, coalesce(q.finality, p.finality) as finality, case when p.finality is null then 1 else 2 end as version from p full outer join q using (row_id) where p.finality is distinct from q.finality")(
    lambda s, d: governance.changelog(snap(s, d, K), snap(s, d, 7500, True)))
query("rev_replay", ROWS + " select row_id, finality from q")(lambda s, d: governance.replay(snap(s, d, K), governance.changelog(snap(s, d, K), snap(s, d, 7500, True))).select("row_id", "finality"))
query("asm_min_coverage", A1 + " , cs as (select key, sum(e - s) as tm, sum(case when an > 0 then e - s else 0 end) as cm from x where tn > 0 group by key) select 'coverage' as rule, count(*) as violations from cs where cm / tm < 0.5")(
    lambda s, d: governance.assess(comp(s, d), [governance.Rule("coverage", "minimum_coverage", 0.5)]).groupBy("rule").agg(F.count(F.lit(1)).alias("violations")))
query("live_liveness", "with " + BASE + f" x as (select source || '/' || key as lane, pos, lead(pos) over (partition by source, key order by pos) as nxt from ev) select lane, pos + 500 as silent_at, nxt as alive_at from x where coalesce(nxt, {H}) - pos >= 500")(
    lambda s, d: live.silences(obs(s, d).select(F.concat_ws("/", "source", "key").alias("lane"), "pos"), 500, horizon(s, d)))
IMPORT = {"input": "csv", "source": "event_type", "position": "position", "key": "user_id", "windows": [{"name": "Big", "active": {"field": "value", "greaterThan": 20}, "tags": [{"name": "t", "field": "event_type"}]}]}


def _import(s, d):
    from tidemark.sources.readers import import_events

    raw = events(s, d).select((F.col("event_id") + 1).cast("string").alias("position"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("value").cast("string").alias("value"))
    return import_events(raw, IMPORT).select("key", "source", F.col("start_position").alias("s"), F.col("end_position").alias("e"))


query("imp_csv_predicate", """with c as (select event_id + 1 as pos, cast(user_id as varchar) as key, event_type as source, value > 20 as act, lag(value > 20, 1, false) over (partition by user_id, event_type order by event_id) as was from events),
d as (select * from c where act <> was) select key, source, s, e from (select key, source, pos as s, lead(pos) over (partition by key, source order by pos) as e, act from d) where act""")(_import)


def at_horizon(h, select):
    """A table expression over the elementary segments of lane-a and lane-b as known at h."""
    clip = f"n as (select key, part, source, rid, s as a, least(coalesce(e, {h}), {h}) as b, e is null or e > {h} as prov from r where s <= {h})"
    return f"(with {clip}{ALIGN.format(against=chr(39) + 'lane-b' + chr(39))} {select})"


def runs(s, d, **kw):
    w = windows(s, d)
    return [compare.Comparison(w, replace(plan(), horizon=None, known_at=h, **kw)) for h in (K, horizon(s, d))]


COVER = "select key, part, sum(e - s)::bigint as tm, sum(case when an > 0 then e - s else 0 end)::bigint as cm from x where tn > 0 group by key, part"
OVER = "select key, part, s, e, case when tp > 0 or ap > 0 then 'Provisional' else 'Final' end as f from x where tn > 0 and an > 0"
query("rev_coverage", W + f", p as {at_horizon(K, COVER)}, q as {at_horizon(H, COVER)} select 'HighValue' as window_name, key, part as partition_id, p.tm as previous_target_magnitude, p.cm as previous_covered_magnitude, p.cm / p.tm as previous_ratio, q.tm as current_target_magnitude, q.cm as current_covered_magnitude, q.cm / q.tm as current_ratio from p full outer join q using (key, part) where p.tm is distinct from q.tm or p.cm is distinct from q.cm")(
    lambda s, d: governance.revision(*runs(s, d))["coverage"])
query("rev_rows", W + f", p as {at_horizon(K, OVER)}, q as {at_horizon(H, OVER)} select change, finality, count(*) as n from (select case when p.f is null then 'Added' when q.f is null then 'Retracted' else 'Revised' end as change, coalesce(q.f, p.f) as finality from p full outer join q using (key, part, s, e) where p.f is distinct from q.f) group by change, finality")(
    lambda s, d: governance.revision(*runs(s, d, comparators=("overlap",)))["rows"].groupBy("change", "finality").agg(F.count(F.lit(1)).alias("n")))
query("asm_suite", A1 + " , cs as (select key, sum(e - s) as tm, sum(case when an > 0 then e - s else 0 end) as cm from x where tn > 0 group by key, part), v as (select unnest(['low', 'high']) as specification, unnest([0.0, 0.5]) as least) select specification, count(*) filter (where cm / tm < least) as violations, count(*) filter (where cm / tm < least) = 0 as passed from v, cs group by specification")(
    lambda s, d: governance.Suite("lanes", (("low", (governance.Rule("c", "minimum_coverage", 0.0),)), ("high", (governance.Rule("c", "minimum_coverage", 0.5),)))).results(comp(s, d)).select("specification", "violations", "passed"))

from tidemark.plans import extended  # noqa: E402, F401  (registers further queries)
