"""Queries over window histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.temporal import AXES, ticks

SCOPE = ["window_name", "key", "partition_id"]
BINS = 8  # of its level that a window is long at most


class Query:
    """Filters that all must hold; every step is a lazy DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _where(self, c) -> "Query":
        return Query(self.df.where(c))

    def window(self, name):
        return self._where(F.col("window_name") == name)

    def key(self, k):
        return self._where(F.col("key") == str(k))

    def source(self, s):
        return self._where(F.col("source").eqNullSafe(s))

    lane = source

    def partition(self, p):
        return self._where(F.col("partition_id").eqNullSafe(p))

    def segment(self, name, value):
        return self._where(F.exists("segments", lambda s: (s["name"] == name) & s["value"].eqNullSafe(F.lit(value))))

    def tag(self, name, value):
        return self._where(F.exists("tags", lambda s: (s["name"] == name) & s["value"].eqNullSafe(F.lit(value))))

    def windows(self):
        return self.df

    def closed(self):
        return self.df.where("end_position is not null")

    def open(self):
        return self.df.where("end_position is null")

    def latest(self):
        """The last window in the total order (not the latest in time)."""
        last = [F.desc("window_name"), F.desc("key"), F.col("source").desc_nulls_last(), F.col("partition_id").desc_nulls_last(), F.desc("start_position"), F.col("end_position").desc_nulls_first(), F.desc("record_id")]
        return self.df.orderBy(*last).limit(1)

    def ordered(self):
        """The windows in the total order."""
        first = [F.asc("window_name"), F.asc("key"), F.col("source").asc_nulls_first(), F.col("partition_id").asc_nulls_first(), F.asc("start_position"), F.col("end_position").asc_nulls_last(), F.asc("record_id")]
        return self.df.orderBy(*first)

    def snapshot_at(self, horizon: int):
        return Query(snapshot_at(self.df, horizon))

    def windows_at(self, horizon: int):
        return snapshot_at(self.df, horizon)

    def closed_at(self, horizon: int):
        return snapshot_at(self.df, horizon).where("finality = 'Final'")

    def open_at(self, horizon: int):
        return snapshot_at(self.df, horizon).where("finality = 'Provisional'")

    def latest_at(self, horizon: int):
        return self.snapshot_at(horizon).latest()


def snapshot_at(windows: DataFrame, horizon: int, axis: str = "position") -> DataFrame:
    """Windows that began by the horizon: Final if they ended by then, else clipped to it and Provisional. On the time axis
    (100 ns units since the epoch) windows that lack a time of theirs drop out, and start_m, end_m are times."""
    if axis == "timestamp":
        h, start, end = F.lit(horizon).cast("long"), ticks("start_time"), ticks("end_time")
        w = windows.where(start.isNotNull() & (F.col("end_position").isNull() | end.isNotNull())).where(start <= h)
        return w.withColumn("finality", F.when(end <= h, "Final").otherwise("Provisional")).withColumn("start_m", start).withColumn("end_m", F.least(F.coalesce(end, h), h))
    h = F.lit(horizon).cast("long")
    return windows.where(F.col("start_position") <= h).withColumn("finality", F.when(F.col("end_position") <= h, "Final").otherwise("Provisional")).withColumn("end_position", F.least(F.coalesce("end_position", h), h))


def _mean_width(scope: WindowSpec) -> Column:
    """How far the windows (start_position, end_position) of a scope lie apart on average."""
    mean = F.ceil((F.max("end_position").over(scope) - F.min("start_position").over(scope)) / F.count(F.lit(1)).over(scope)).cast("long")
    return F.greatest(F.lit(1).cast("long"), mean)


def _bin(df: DataFrame, scope: list[str]) -> DataFrame:
    """df (start_position, end_position) with `width` and a row for each time bin that a window touches. Bins are as wide as
    the windows of a scope lie apart on average, so windows that do not overlap have about two each."""
    out = df.withColumn("width", _mean_width(Window.partitionBy(*scope)))
    last = F.greatest(F.col("end_position") - 1, F.col("start_position"))
    return out.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_position") / F.col("width")), F.floor(last / F.col("width")))))


def find_overlaps(windows: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Pairs of closed windows of one scope that overlap, first by (start, end, id). A pair meets once, where the later one
    starts: bins double in width from level to level, a window lies in those it touches on the level where they are few, and
    every start in one bin of each level that its scope has. So no window has more rows for being long. bin_width: of the
    narrowest bins, instead of a width for each scope."""
    on = [*SCOPE, "ctx"]
    held = ("source", "start_position", "end_position", "record_id")
    scope = Window.partitionBy(*on)
    c = windows.where("end_position is not null").select(*SCOPE, F.to_json("segments").alias("ctx"), *held)
    c = c.withColumn("width", _mean_width(scope) if bin_width is None else F.lit(bin_width).cast("long"))
    over = F.expr(f"(end_position - start_position - 1) div width div {BINS}")
    c = c.withColumn("level", F.when(F.col("end_position") > F.col("start_position"), F.when(over > 0, F.length(F.bin(over))).otherwise(0)))
    c = c.withColumn("levels", F.collect_set("level").over(scope))
    at = lambda p: F.call_function("shiftright", F.expr(f"({p} - pmod({p}, width)) div width"), F.col("level"))
    a = c.where("level is not null").select(*on, "level", *[F.col(x).alias(f"first_{x}") for x in held], F.explode(F.sequence(at("start_position"), at("end_position - 1"))).alias("bin"))
    b = c.withColumn("level", F.explode("levels")).select(*[F.col(x).alias("of_" + x) for x in (*on, "level")], *[F.col(x).alias(f"second_{x}") for x in held], at("start_position").alias("of_bin"))
    # merged: Spark estimates the size before rows are dealt to bins, by which it would broadcast what fits no driver
    pair = a.join(b.hint("merge"), [a[x].eqNullSafe(b["of_" + x]) for x in on] + [a[x] == b["of_" + x] for x in ("level", "bin")])
    hit = pair.where("first_start_position < second_end_position and second_start_position < first_end_position").where("struct(first_start_position, first_end_position, first_record_id) < struct(second_start_position, second_end_position, second_record_id)")
    return hit.select(*SCOPE, *[f"{s}_{x}" for s in ("first", "second") for x in held], F.greatest("first_start_position", "second_start_position").alias("overlap_start"), F.least("first_end_position", "second_end_position").alias("overlap_end"))


def find_residuals(windows: DataFrame, source: str) -> DataFrame:
    """Parts of a source's closed windows that no other source's closed window of the scope covers. A sweep by running sums
    finds the stretches without cover between the boundaries of a scope; they meet the source's windows in time bins."""
    c = windows.where("end_position is not null and end_position > start_position").withColumn("ctx", F.to_json("segments"))
    scope = [*SCOPE, "ctx"]
    mine = F.col("source").eqNullSafe(source)
    ends = F.array(F.struct(F.col("start_position").alias("p"), F.when(mine, 0).otherwise(1).alias("d")), F.struct(F.col("end_position").alias("p"), F.when(mine, 0).otherwise(-1).alias("d")))
    sums = c.select(*scope, F.explode(ends).alias("x")).groupBy(*scope, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*scope).orderBy("p")
    bare = sums.select(*scope, F.col("p").alias("start_position"), F.lead("p").over(w).alias("end_position"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).where("n = 0 and end_position is not null")
    both = c.where(mine).select(*scope, "record_id", "start_position", "end_position").unionByName(bare.select(*scope, F.lit(None).cast("string").alias("record_id"), "start_position", "end_position"))
    dealt = _bin(both, scope)
    own = dealt.where("record_id is not null").select(*scope, "bin", "width", "record_id", F.col("start_position").alias("a"), F.col("end_position").alias("b"))
    gap = dealt.where("record_id is null").select(*[F.col(x).alias("g_" + x) for x in (*scope, "bin")], F.col("start_position").alias("s"), F.col("end_position").alias("e"))
    met = own.join(gap, [own[x].eqNullSafe(gap["g_" + x]) for x in (*scope, "bin")]).where((F.col("s") < F.col("b")) & (F.col("a") < F.col("e"))).where(F.col("bin") == F.floor(F.greatest("a", "s") / F.col("width")))
    parts = met.select(*scope, "record_id", F.greatest("a", "s").alias("s"), F.least("b", "e").alias("e"))
    o = Window.partitionBy("record_id").orderBy("s")  # pieces that touch are one residual
    island = F.sum(F.when(F.col("s") == F.lag("e").over(o), 0).otherwise(1)).over(o)
    return parts.withColumn("g", island).groupBy(*SCOPE, "record_id", "g").agg(F.min("s").alias("start_position"), F.max("e").alias("end_position")).drop("g")


def summarise(windows: DataFrame, column: str, name: str, horizon: int | None = None) -> DataFrame:
    """Counts and total length of the windows under each value of a segment or tag."""
    snap = snapshot_at(windows, horizon) if horizon is not None else windows.withColumn("finality", F.when(F.col("end_position").isNull(), "Provisional").otherwise("Final"))
    values = F.array_distinct(F.transform(F.filter(column, lambda s: s["name"] == name), lambda s: s["value"]))
    x = snap.select(F.explode(values).alias("value"), "finality", (F.col("end_position") - F.col("start_position")).alias("length"))
    return x.groupBy("value").agg(F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("finality") == "Final").alias("final_count"), F.count_if(F.col("finality") != "Final").alias("provisional_count"),
                                  F.count("length").alias("measured_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))


def annotate(annotations: DataFrame) -> DataFrame:
    """Appended annotations (target, name, value, known_at, seq) with their revision."""
    return annotations.withColumn("revision", F.row_number().over(Window.partitionBy("target", "name").orderBy("seq")))


def annotations_known_at(annotations: DataFrame, horizon: int, axis: str = "position", clock: str | None = None) -> DataFrame:
    """Those known by the horizon, with their revision among all. Annotations may carry `axis` and `clock` of known_at (without:
    positions); only those on the horizon's axis count, of timestamps only those of its clock. A null known_at is never known."""
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis}")
    own = F.coalesce(F.col("axis"), F.lit("position")) if "axis" in annotations.columns else F.lit("position")
    same = own == axis
    if axis == "timestamp":
        same = same & (F.col("clock") if "clock" in annotations.columns else F.lit(None).cast("string")).eqNullSafe(F.lit(clock))
    return annotate(annotations).where(same & (F.col("known_at") <= horizon))


def validate(windows: DataFrame) -> DataFrame:
    """One row per broken rule and record."""
    rules = {"blank window name": "window_name is null or trim(window_name) = ''", "null key": "key is null", "negative start": "start_position < 0", "end before start": "end_position < start_position",
             "end time without start time": "end_time is not null and start_time is null", "open window with end time": "end_position is null and end_time is not null", "end time before start time": "end_time < start_time"}
    return windows.select("record_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]))).alias("problem"))


def duplicate_open(windows: DataFrame) -> DataFrame:
    return windows.where("end_position is null").groupBy("window_name", "key", "source", "partition_id").count().where("count > 1")
