"""Staged comparison: prepare (select, scope, normalise), align (elementary intervals), comparators, finality.

Alignment has two forms. The counts form is one running sum over the boundaries of a scope (O(n log n), no range join)
and carries the numbers of active records, provisional records and distinct against sources. The lineage form adds the
ids of the active records and is used only where ids are asked for."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.temporal import saturating_subtract, ticks
from tidemark.plans.comparison import Plan, parse_comparator

SCOPE = ["window_name", "key", "partition_id", "ctx"]


def _ranges(windows: DataFrame, plan: Plan):
    """(start, end, whether the end is the horizon's, why the window is refused or null) on the plan's axis."""
    if plan.axis == "position":
        start, end = F.col("start_position"), F.col("end_position")
    else:
        start, end = ticks("start_time"), ticks("end_time")
    open_ = F.col("end_position").isNull()
    clipped = open_
    if plan.known_at is not None and plan.axis == "position" and plan.availability == "position":
        k = F.lit(plan.known_at).cast("long")
        clipped = open_ | (F.col("end_position") > k)
        end = F.least(F.coalesce(end, k), k)
    elif plan.horizon is not None:
        end = F.when(open_, F.lit(plan.horizon).cast("long")).otherwise(end)
    missing = F.lit(False) if plan.axis == "position" else F.col("start_time").isNull() | (~open_ & F.col("end_time").isNull())
    why = F.when(missing, "MissingEventTime").when(end.isNull(), "OpenWindowsWithoutPolicy").when(end < start, "InvalidRangeDuration")
    return start.cast("long"), end.cast("long"), clipped, why


def _known(windows: DataFrame, plan: Plan) -> Column:
    """Whether a window is known at the plan's known-at: begun by then, or (availability "record") by the record's own
    known_at, else its end, else its start."""
    if plan.known_at is None:
        return F.lit(True)
    if plan.availability == "record":
        own = [F.col("known_at")] if "known_at" in windows.columns else []
        return F.coalesce(*own, F.col("end_position"), F.col("start_position")) <= plan.known_at
    return F.col("start_position") <= plan.known_at


def prepare(windows: DataFrame, plan: Plan) -> DataFrame:
    """Normalised records: scope columns, side, source, record_id, start_m, end_m, end_status. A window that the plan's
    policies refuse (open without a horizon, a missing time, an end before its start, a record on both sides) fails the
    query with its code when it is executed, as no row may come of such a run; diagnostics() tells beforehand."""
    w = windows.where(_known(windows, plan)).where(plan.scope())
    start, end, clipped, why = _ranges(windows, plan)
    target, against = plan.target.predicate, plan.against_predicate()
    sides = F.array_compact(F.array(F.when(target & against, F.raise_error(F.lit("SelfComparison")).cast("string")).when(target, F.lit("target")), F.when(against, F.lit("against"))))
    ctx = F.to_json("segments") if plan.use_segments else F.lit("")
    passes = why.isNull() | (F.lit(plan.missing_time == "exclude") & (why == "MissingEventTime"))
    checked = F.when(passes, end).otherwise(F.raise_error(F.concat(why, F.lit(": "), F.coalesce("record_id", F.lit("")))).cast("long"))
    out = w.select("window_name", "key", "partition_id", ctx.alias("ctx"), "source", "record_id", start.alias("start_m"), checked.alias("end_m"), F.when(clipped, "OpenAtHorizon").otherwise("Closed").alias("end_status"), F.explode(sides).alias("side"))
    out = out.where("start_m is not null and end_m is not null")
    if plan.duplicates == "reject":
        out = out.withColumn("rn", _copy_number()).where("rn = 1").drop("rn")
    return coalesce_adjacent(out) if plan.coalesce else out


def _copy_number() -> Column:
    return F.row_number().over(Window.partitionBy("side", *SCOPE, "source", "start_m", "end_m").orderBy("record_id"))


def excluded(windows: DataFrame, plan: Plan) -> DataFrame:
    """record_id, reason of the windows in scope or in the future that the plan leaves out, and of those it refuses."""
    start, end, _, why = _ranges(windows, plan)
    chosen = plan.target.predicate | plan.against_predicate()
    reason = F.when(~_known(windows, plan), "FutureWindow").when(~plan.scope(), "OutOfScope").when(~chosen, "NotSelected").otherwise(why)
    out = windows.select("record_id", reason.alias("reason")).where("reason is not null")
    if plan.duplicates == "reject":
        norm = prepare(windows, replace(plan, duplicates="preserve", coalesce=False))
        out = out.unionByName(norm.withColumn("rn", _copy_number()).where("rn > 1").select("record_id", F.lit("DuplicateWindow").alias("reason")))
    return out


def coalesce_adjacent(norm: DataFrame) -> DataFrame:
    """Windows of one side, scope and source that end where the next begins become one."""
    by = ["side", *SCOPE, "source"]
    w = Window.partitionBy(*by).orderBy("start_m", "end_m", "record_id")
    island = F.sum(F.when(F.col("start_m") == F.lag("end_m").over(w), 0).otherwise(1)).over(w)
    return norm.withColumn("g", island).groupBy(*by, "g").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.array_join(F.array_sort(F.collect_list("record_id")), "+").alias("record_id"), F.max("end_status").alias("end_status")).drop("g")


def diagnostics(windows: DataFrame, plan: Plan) -> DataFrame:
    """Data-dependent findings, counted in one pass: open windows without a policy, missing times, ranges that end before they
    start, future windows, records on both sides."""
    _, _, _, why = _ranges(windows, plan)
    target, against, known = plan.target.predicate, plan.against_predicate(), _known(windows, plan)
    chosen = known & (target | against)
    n = lambda c, name: F.count_if(c).alias(name)
    return windows.where(plan.scope()).agg(n(chosen & (why == "OpenWindowsWithoutPolicy"), "OpenWindowsWithoutPolicy"), n(chosen & (why == "MissingEventTime"), "MissingEventTime"), n(chosen & (why == "InvalidRangeDuration"), "InvalidRangeDuration"),
                                           n((target | against) & ~known, "FutureWindowExcluded"), n(known & target & against, "SelfComparison"))


BLOCKING = ("OpenWindowsWithoutPolicy", "MissingEventTime", "InvalidRangeDuration", "SelfComparison")


def errors(windows: DataFrame, plan: Plan) -> list[str]:
    """Codes that block a run over these windows (one small aggregate)."""
    found = diagnostics(windows, plan).first()
    return [c for c in BLOCKING if found[c] and not (c == "MissingEventTime" and plan.missing_time == "exclude")]


def align(norm: DataFrame, cohort: bool = False, scope: list[str] = SCOPE, bin_width: int | None = None) -> DataFrame:
    """Counts form: scope, start_m, end_m, target_n, against_n, target_prov, against_prov (and active_sources for cohorts).
    bin_width: running sums in two levels, over bins of the axis and within them, so a scope of many boundaries is spread
    over as many tasks as it has bins; a bin needs no more than the sums before it and the next bin's first boundary."""
    one = lambda side, prov=False: F.when((F.col("side") == side) & ((F.col("end_status") == "OpenAtHorizon") if prov else F.lit(True)), F.col("x.d")).otherwise(0)
    ends = lambda s, e: F.explode(F.array(F.struct(F.col(s).alias("p"), F.lit(1).alias("d")), F.struct(F.col(e).alias("p"), F.lit(-1).alias("d")))).alias("x")
    pts = norm.select(*scope, "side", "end_status", ends("start_m", "end_m"))
    pts = pts.select(*scope, F.col("x.p").alias("p"), one("target").alias("t"), one("against").alias("a"), one("target", True).alias("tp"), one("against", True).alias("ap"), F.lit(0).alias("s"))
    if cohort:
        by = [*scope, "source"]
        w = Window.partitionBy(*by).orderBy("start_m", "end_m")
        reach = F.max("end_m").over(w.rowsBetween(Window.unboundedPreceding, -1))
        n = norm.where("side = 'against' and source is not null and start_m < end_m").withColumn("new", F.when(F.col("start_m") <= reach, 0).otherwise(1))
        isl = n.withColumn("g", F.sum("new").over(w)).groupBy(*by, "g").agg(F.min("start_m").alias("b"), F.max("end_m").alias("e"))
        zero = F.lit(0)
        pts = pts.unionByName(isl.select(*scope, ends("b", "e")).select(*scope, "x.p", zero.alias("t"), zero.alias("a"), zero.alias("tp"), zero.alias("ap"), F.col("x.d").alias("s")))
    names = {"t": "target_n", "a": "against_n", "tp": "target_prov", "ap": "against_prov", "s": "active_sources"}
    sums = pts.groupBy(*scope, "p").agg(*[F.sum(c).alias(c) for c in names])
    if bin_width is None:
        w = Window.partitionBy(*scope).orderBy("p")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        seg = sums.select(*scope, F.col("p").alias("start_m"), F.lead("p").over(w).alias("end_m"), *[F.sum(c).over(run).alias(n) for c, n in names.items()])
    else:
        sums = sums.withColumn("bin", F.floor(F.col("p") / bin_width))
        over = Window.partitionBy(*scope).orderBy("bin")
        bins = sums.groupBy(*scope, "bin").agg(F.min("p").alias("first"), *[F.sum(c).alias(c) for c in names])
        bins = bins.select(*[F.col(c).alias("b_" + c) for c in scope], F.col("bin").alias("b_bin"), F.lead("first").over(over).alias("next"), *[F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_" + c) for c in names])
        w = Window.partitionBy(*scope, "bin").orderBy("p")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        j = sums.join(bins, [F.col(c).eqNullSafe(F.col("b_" + c)) for c in (*scope, "bin")])
        seg = j.select(*scope, F.col("p").alias("start_m"), F.coalesce(F.lead("p").over(w), F.col("next")).alias("end_m"), *[(F.sum(c).over(run) + F.col("before_" + c)).alias(n) for c, n in names.items()])
    return seg.where("end_m is not null and (target_n > 0 or against_n > 0)")


def align_lineage(norm: DataFrame) -> DataFrame:
    """Lineage form: the ids of the records active in each elementary interval."""
    seg = align(norm)
    n = norm.where("start_m < end_m").select(*[F.col(c).alias("n_" + c) for c in (*SCOPE, "side", "record_id", "start_m", "end_m")])
    on = [F.col(c).eqNullSafe(F.col("n_" + c)) for c in SCOPE] + [F.col("n_start_m") <= F.col("start_m"), F.col("n_end_m") >= F.col("end_m")]
    j = seg.join(n, on).select(*seg.columns, F.col("n_side").alias("side"), F.col("n_record_id").alias("record_id"))
    ids = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("record_id"))))
    return j.groupBy(*seg.columns).agg(ids("target").alias("target_ids"), ids("against").alias("against_ids"))


def against_active(plan: Plan) -> Column:
    return plan.cohort.rule(F.col("active_sources")) if plan.cohort else F.col("against_n") > 0


def _final(*flags) -> Column:
    c = F.lit(False)
    for f in flags:
        c = c | (F.col(f) > 0)
    return F.when(c, "Provisional").otherwise("Final").alias("finality")


def _finality(*statuses: Column) -> Column:
    """Of a row that rests on records of these end statuses (null: none)."""
    return F.when(F.greatest(*[F.coalesce(s, F.lit("Closed")) for s in (*statuses, F.lit("Closed"))]) == "OpenAtHorizon", "Provisional").otherwise("Final").alias("finality")


class Comparison:
    """Lazy results of one plan over windows; comparators share the aligned segments."""

    def __init__(self, windows: DataFrame, plan: Plan):
        bad = [d for d in plan.validate() if d.error]
        if bad:
            raise ValueError("; ".join(d.code for d in bad))
        self.windows, self.plan = windows, plan
        self.norm = prepare(windows, plan)
        self.aligned = align(self.norm, plan.cohort is not None)
        self.active = against_active(plan)

    def run(self) -> dict[str, DataFrame]:
        return {c: self.rows(c) for c in self.plan.comparators}

    def rows(self, comparator: str) -> DataFrame:
        kind = parse_comparator(comparator)
        if kind[0] == "lead-lag":
            return self.lead_lag(kind[1], kind[3])
        if kind[0] == "asof":
            return self.as_of(kind[1], kind[3])
        return getattr(self, kind[0].replace("-", "_"))()

    def overlap(self):
        return self.aligned.where((F.col("target_n") > 0) & self.active).select(*SCOPE, "start_m", "end_m", "target_n", "against_n", _final("target_prov", "against_prov"))

    def residual(self):
        flags = ("target_prov", "against_prov") if self.plan.cohort else ("target_prov",)
        return self.aligned.where((F.col("target_n") > 0) & ~self.active).select(*SCOPE, "start_m", "end_m", "target_n", _final(*flags))

    def missing(self):
        return self.aligned.where((F.col("target_n") == 0) & self.active).select(*SCOPE, "start_m", "end_m", "against_n", _final("against_prov"))

    def coverage(self):
        m = F.col("end_m") - F.col("start_m")
        return self.aligned.where("target_n > 0").select(*SCOPE, "start_m", "end_m", m.alias("target_magnitude"), F.when(self.active, m).otherwise(0).alias("covered_magnitude"), _final("target_prov", "against_prov"))

    def coverage_summary(self):
        c = self.coverage().groupBy("window_name", "key", "partition_id").agg(F.sum("target_magnitude").alias("target_magnitude"), F.sum("covered_magnitude").alias("covered_magnitude"))
        return c.withColumn("ratio", F.when(F.col("target_magnitude") == 0, 0.0).otherwise(F.col("covered_magnitude") / F.col("target_magnitude")))

    def gap(self):
        w = Window.partitionBy(*SCOPE).orderBy("start_m")
        prov = F.col("target_prov") + F.col("against_prov")
        g = self.aligned.select(*SCOPE, F.col("end_m").alias("start_m"), F.lead("start_m").over(w).alias("end_m"), F.greatest(prov, F.lead(prov).over(w)).alias("prov"))
        return g.where("end_m > start_m").select(*SCOPE, "start_m", "end_m", _final("prov"))

    def symmetric_difference(self):
        t = F.col("target_n") > 0
        return self.aligned.where(t != self.active).select(*SCOPE, "start_m", "end_m", F.when(t, "Target").otherwise("Against").alias("side"), _final("target_prov", "against_prov"))

    def containment(self):
        """Contained segments once, whatever the cohort rule; others once per target record, by the end they share."""
        inside = self.aligned.where("target_n > 0 and against_n > 0").select(*SCOPE, "start_m", "end_m", F.lit("Contained").alias("status"), F.lit(None).cast("string").alias("record_id"), _final("target_prov", "against_prov"))
        out = self.aligned.where("target_n > 0 and against_n = 0")
        t = self.norm.where("side = 'target' and start_m < end_m").select(*SCOPE, "record_id", F.col("start_m").alias("ts"), F.col("end_m").alias("te"), F.col("end_status").alias("st"))
        j = out.join(t, [out[c].eqNullSafe(t[c]) for c in SCOPE] + [t["ts"] <= out["start_m"], t["te"] >= out["end_m"]]).select(*[out[c] for c in SCOPE], "start_m", "end_m", F.when(F.col("start_m") == F.col("ts"), "LeftOverhang").when(F.col("end_m") == F.col("te"), "RightOverhang").otherwise("NotContained").alias("status"), "record_id", _finality(F.col("st")))
        return inside.unionByName(j)

    def _nearest(self, column: str) -> DataFrame:
        """Target transitions with the candidates before (or at) and after (or at) them: points, least ids, counts."""
        n = self.norm
        cand = n.where("side = 'against'").groupBy(*SCOPE, F.col(column).alias("p")).agg(F.min(F.struct(F.col("record_id").alias("id"), F.col("end_status").alias("st"))).alias("x"), F.count(F.lit(1)).alias("n"))
        none = F.lit(None).cast("string")
        both = n.where("side = 'target'").select(*SCOPE, F.col(column).alias("p"), F.col("record_id").alias("tid"), F.col("end_status").alias("tst"), F.lit(None).cast("struct<p:bigint,id:string,n:bigint,st:string>").alias("c")).unionByName(
            cand.select(*SCOPE, "p", none.alias("tid"), none.alias("tst"), F.struct("p", F.col("x.id").alias("id"), "n", F.col("x.st").alias("st")).alias("c")))
        w = Window.partitionBy(*SCOPE).orderBy("p")
        back = F.last("c", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
        ahead = F.first("c", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
        return both.withColumn("b", back).withColumn("f", ahead).where("tid is not null").withColumn("bd", saturating_subtract(F.col("p"), F.col("b.p"))).withColumn("fd", saturating_subtract(F.col("f.p"), F.col("p")))

    def lead_lag(self, transition: str = "Start", tolerance: int = 0):
        x = self._nearest("start_m" if transition == "Start" else "end_m")
        first = F.col("bd").isNotNull() & (F.col("fd").isNull() | (F.col("bd") < F.col("fd")) | ((F.col("bd") == F.col("fd")) & (F.col("b.id") <= F.col("f.id"))))
        m = F.when(first, F.col("b")).otherwise(F.col("f"))
        d = F.col("p") - m["p"]
        return x.select(*SCOPE, F.col("tid").alias("record_id"), F.col("p").alias("target_m"), m["p"].alias("against_m"), m["id"].alias("against_id"), d.alias("delta"),
                        F.when(m.isNull(), "MissingComparison").when(d < 0, "TargetLeads").when(d > 0, "TargetLags").otherwise("Equal").alias("direction"), F.when(m.isNotNull(), F.abs(d) <= tolerance).otherwise(False).alias("within_tolerance"), _finality(F.col("tst"), m["st"]))

    def lead_lag_summary(self, transition: str = "Start", tolerance: int = 0):
        r = self.lead_lag(transition, tolerance)
        c = lambda v: F.count_if(F.col("direction") == v)
        return r.agg(F.count(F.lit(1)).alias("row_count"), c("TargetLeads").alias("leads"), c("TargetLags").alias("lags"), c("Equal").alias("equal"), c("MissingComparison").alias("missing"),
                     F.count_if(~F.col("within_tolerance") & (F.col("direction") != "MissingComparison")).alias("outside_tolerance"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"))

    def as_of(self, direction: str = "Previous", tolerance: int = 0):
        x = self._nearest("start_m")
        bd, fd, b, f = F.col("bd"), F.col("fd"), F.col("b"), F.col("f")
        if direction == "Previous":
            d, m, many = bd, b, b["n"] > 1
        elif direction == "Next":
            d, m, many = fd, f, f["n"] > 1
        else:
            d = F.least(bd, fd)
            tie = (bd == fd) & (bd > 0)
            m = F.when(fd.isNull() | (bd < fd) | ((bd == fd) & (b["id"] <= f["id"])), b).otherwise(f)
            many = tie | (m["n"] > 1)
        future = fd.isNotNull() & bd.isNull() if direction == "Previous" else F.lit(False)
        status = F.when(future, "FutureRejected").when(d.isNull() | (d > tolerance), "NoMatch").when(F.coalesce(many, F.lit(False)), "Ambiguous").when(d == 0, "Exact").otherwise("Matched")
        hit = status.isin("Exact", "Matched", "Ambiguous")
        return x.select(*SCOPE, F.col("tid").alias("record_id"), F.col("p").alias("target_m"), F.when(hit, m["p"]).alias("against_m"), F.when(hit, m["id"]).alias("against_id"), F.when(future, fd).otherwise(d).alias("distance"), status.alias("status"), _finality(F.col("tst"), F.when(hit, m["st"])))

    def totals(self, comparator: str) -> DataFrame:
        r = self.rows(comparator)
        return r.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col("end_m") - F.col("start_m")), F.lit(0)).alias("total_length"))

    def trace(self, rows: DataFrame) -> DataFrame:
        """The normalised records behind range rows of a comparator, one row for each: the row's scope and range, and side,
        record_id, record_start, record_end, end_status of what is active throughout it in its scope."""
        on = [c for c in (*SCOPE, "start_m", "end_m") if c in rows.columns]
        n = self.norm.where("start_m < end_m").select(*[F.col(c).alias("n_" + c) for c in SCOPE], "side", "record_id", F.col("start_m").alias("record_start"), F.col("end_m").alias("record_end"), "end_status")
        r = rows.select(*on)
        cond = [r[c].eqNullSafe(F.col("n_" + c)) for c in on if c in SCOPE] + [F.col("record_start") <= r["start_m"], F.col("record_end") >= r["end_m"]]
        return r.join(n, cond).select(*on, "side", "record_id", "record_start", "record_end", "end_status")

    def finality_counts(self) -> DataFrame:
        """comparator, finality, rows of every comparator of the plan."""
        out = None
        for name, rows in self.run().items():
            one = rows.groupBy("finality").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("comparator"), "finality", "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def has_provisional(self) -> bool:
        return any(not rows.where("finality = 'Provisional'").isEmpty() for rows in self.run().values())


def source_matrix(windows: DataFrame, window: str, sources: list[str]) -> DataFrame:
    """Directional N x N cells from one alignment: every record is dealt to the pairs it takes part in, the pair being part of
    the scope. Off the diagonal, a cell with an open window of either source is blocked: zero counts, null ratio."""
    spark = windows.sparkSession
    if len(set(sources)) < len(sources):
        raise ValueError("sources must be unique")
    w = windows.where((F.col("window_name") == window) & F.col("source").isin(*sources))
    grid = spark.createDataFrame([(a, b) for a in sources for b in sources], "target string, against string")
    has = w.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("end_position").isNull()).alias("open"))
    arr = F.array(*[F.lit(s) for s in sources])
    role = lambda side: F.transform(arr, lambda o: F.struct(F.lit(side).alias("side"), (F.col("source") if side == "target" else o).alias("t"), (o if side == "target" else F.col("source")).alias("a")))
    norm = w.where("end_position is not null").select("window_name", "key", "partition_id", F.to_json("segments").alias("ctx"), "source", F.col("start_position").alias("start_m"), F.col("end_position").alias("end_m"), F.lit("Closed").alias("end_status"),
                                                    F.explode(F.filter(F.concat(role("target"), role("against")), lambda r: r["t"] != r["a"])).alias("r")).select("window_name", "key", "partition_id", "ctx", F.col("r.t").alias("target"), F.col("r.a").alias("against"), F.col("r.side").alias("side"), "source", "start_m", "end_m", "end_status")
    m = F.col("end_m") - F.col("start_m")
    t, a = F.col("target_n") > 0, F.col("against_n") > 0
    cells = align(norm, scope=[*SCOPE, "target", "against"]).groupBy("target", "against").agg(
        F.count_if(t & a).alias("o"), F.count_if(t & ~a).alias("r"), F.count_if(~t & a).alias("m"), F.count_if(t).alias("c"), F.sum(F.when(t, m).otherwise(0)).alias("tm"), F.sum(F.when(t & a, m).otherwise(0)).alias("cm"))
    th = has.select(F.col("source").alias("target"), F.col("n").alias("tn"), F.col("open").alias("topen"))
    ah = has.select(F.col("source").alias("against"), F.col("n").alias("an"), F.col("open").alias("aopen"))
    x = grid.join(th, "target", "left").join(ah, "against", "left").join(cells, ["target", "against"], "left")
    same = F.col("target") == F.col("against")
    ok = ~same & (F.coalesce("topen", F.lit(0)) == 0) & (F.coalesce("aopen", F.lit(0)) == 0)
    n = lambda c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0)
    ratio = F.when(same, F.when(F.col("tn") > 0, 1.0)).when(ok & (F.coalesce("tm", F.lit(0)) > 0), F.col("cm") / F.col("tm")).when(ok & (F.col("tn") > 0), 0.0)
    return x.select("target", "against", (F.coalesce("tn", F.lit(0)) > 0).alias("target_has_windows"), (F.coalesce("an", F.lit(0)) > 0).alias("against_has_windows"), n("o").alias("overlap_rows"), n("r").alias("residual_rows"), n("m").alias("missing_rows"), n("c").alias("coverage_rows"), ratio.alias("coverage_ratio"))


def matrix_cell(matrix: DataFrame, target: str, against: str) -> DataFrame:
    """The cell of a source matrix: one row, or none for sources it does not have."""
    return matrix.where((F.col("target") == target) & (F.col("against") == against))


def hierarchy(windows: DataFrame, parent: str, child: str, bin_width: int | None = 1 << 14) -> DataFrame:
    """Elementary intervals of a parent and a child family per (source, partition), whatever their keys; closed windows. As a
    scope holds the windows of all keys, it is swept in bins of `bin_width`."""
    side = F.when(F.col("window_name") == parent, "target").when(F.col("window_name") == child, "against")
    n = windows.where(F.col("window_name").isin(parent, child) & F.col("end_position").isNotNull()).select(F.lit("").alias("window_name"), F.coalesce("source", F.lit("<null>")).alias("key"), "partition_id", F.lit("").alias("ctx"), "source", F.col("start_position").alias("start_m"), F.col("end_position").alias("end_m"), F.lit("Closed").alias("end_status"), side.alias("side"))
    return align(n, bin_width=bin_width).select(F.col("key").alias("source"), "partition_id", "start_m", "end_m", F.when((F.col("target_n") > 0) & (F.col("against_n") > 0), "ParentExplained").when(F.col("target_n") > 0, "UnexplainedParent").otherwise("OrphanChild").alias("kind"))


def hierarchy_diagnostics(windows: DataFrame, parent: str, child: str) -> DataFrame:
    """code, path of the warnings of a hierarchy: no windows of a family, or open ones, which it leaves out."""
    of = lambda n: F.col("window_name") == n
    n = windows.agg(F.count_if(of(parent)).alias("p"), F.count_if(of(child)).alias("c"), F.count_if((of(parent) | of(child)) & F.col("end_position").isNull()).alias("o"))
    warn = lambda when, code, path: F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path")))
    found = F.array(warn("p = 0", "MissingLineage", "parentWindowName"), warn("c = 0", "MissingLineage", "childWindowName"), warn("o > 0", "HierarchyOpenWindowsWithoutHorizon", "windowNames"))
    return n.select(F.explode(F.array_compact(found)).alias("x")).select("x.*")
