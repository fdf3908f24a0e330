"""Events to windows: predicate transitions, segments, debounce, roll-ups. Batch form, on window functions.

Input: a DataFrame of observations with `pos` (a unique ingest ordinal), `key`, `source`, `partition_id`, `active`,
and whatever is carried along. A lane is (key, source, partition_id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

LANE = ["key", "source", "partition_id"]


@dataclass(frozen=True)
class WindowDefinition:
    """A window family: who it is about, when it is active, what splits it and what it carries."""

    name: str
    active: Column
    key: Column
    source: Column | None = None
    partition: Column | None = None
    segments: dict[str, Column] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    tags: dict[str, Column] = field(default_factory=dict)
    event_time: Column | None = None
    normalise_key: Callable[[Column], Column] | None = None


def _named(cols: dict[str, Column], parents: dict[str, str] | None = None) -> Column:
    form = "array<struct<name:string,value:string" + (",parent_name:string>>" if parents is not None else ">>")
    parent = lambda n: [F.lit(parents.get(n)).cast("string").alias("parent_name")] if parents is not None else []
    return F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"), *parent(n)) for n, c in cols.items()]).cast(form) if cols else F.array().cast(form)


def observed(position: Column, d: WindowDefinition) -> list[Column]:
    """The columns of an observation of this family; raw_key is the key before its normaliser."""
    key, null = d.key.cast("string"), F.lit(None).cast("string")
    return [position.cast("long").alias("pos"), F.lit(d.name).alias("window_name"), (d.normalise_key(key) if d.normalise_key else key).alias("key"), (d.source.cast("string") if d.source is not None else null).alias("source"),
            (d.partition.cast("string") if d.partition is not None else null).alias("partition_id"), F.coalesce(d.active, F.lit(False)).alias("active"), _named(d.segments, d.parents).alias("segments"), _named(d.tags).alias("tags"),
            (d.event_time.cast("timestamp") if d.event_time is not None else F.lit(None).cast("timestamp")).alias("time"), key.alias("raw_key")]


def observe(events: DataFrame, position: Column, d: WindowDefinition) -> DataFrame:
    """One observation per event; null keys are left out, a null predicate is inactive."""
    return events.select(*observed(position, d)).where("key is not null")


def admitted(obs: DataFrame, arrival: str) -> DataFrame:
    """obs with `rejected`: null, or why an observation must not be recorded. Observations of a lane arrive in the order of the
    column `arrival`; one that is not after all before it is out of order, one without a position or key is incomplete. Only
    what is admitted goes on, so a bad event leaves no state."""
    w = Window.partitionBy("window_name", *LANE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("pos") <= F.max("pos").over(w)
    return obs.withColumn("rejected", F.when(F.col("pos").isNull() | F.col("key").isNull(), "Incomplete").when(F.col("pos") < 0, "NegativePosition").when(late, "OutOfOrder"))


def record_id(*parts) -> Column:
    """The parts with separators between them; null parts and separators within parts are escaped, so ids of differing parts
    differ."""
    one = lambda c: F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), F.lit("\\n"))
    return F.concat_ws("|", *[one(F.col(p) if isinstance(p, str) else p) for p in parts])


def _changes(was: Column, now: Column) -> Column:
    """Segments that differ between two contexts, by name: segment_name, previous, current."""
    names = F.array_distinct(F.concat(F.transform(was, lambda s: s["name"]), F.transform(now, lambda s: s["name"])))
    value = lambda of, n: F.element_at(F.map_from_arrays(F.transform(of, lambda s: s["name"]), F.transform(of, lambda s: s["value"])), n)
    return F.filter(F.transform(names, lambda n: F.struct(n.alias("segment_name"), value(was, n).alias("previous"), value(now, n).alias("current"))), lambda c: ~c["previous"].eqNullSafe(c["current"]))


def record(obs: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """Windows of observations: false to true opens, true to false closes; another segment context while active closes and
    reopens at the same position. Tags are those of the opening observation. context: columns that make lanes of their own."""
    w = Window.partitionBy("window_name", *LANE, *context).orderBy("pos")
    state = F.when(F.col("active"), F.struct("segments"))
    was = F.lag(state).over(w)
    cut = obs.withColumn("st", state).withColumn("was", was).where(~F.col("st").eqNullSafe(F.col("was")))
    end = F.lead("pos").over(w)
    nxt = F.lead("st").over(w)
    out = cut.select("window_name", *LANE, F.col("pos").alias("start_position"), end.alias("end_position"), F.col("time").alias("start_time"), F.lead("time").over(w).alias("end_time"),
                     "segments", "tags", "active", F.when(end.isNull(), None).when(nxt.isNull(), F.lit("ActivePredicateEnded")).otherwise(F.lit("SegmentChanged")).alias("boundary_reason"),
                     F.when(nxt.isNotNull(), _changes(F.col("segments"), nxt["segments"])).alias("boundary_changes"), *context).where("active").drop("active")
    return out.withColumn("record_id", record_id("window_name", *LANE, "start_position", *context)).drop(*context)


def record_families(events: DataFrame, position: Column, definitions: list[WindowDefinition]) -> DataFrame:
    """Several independent families from the same events."""
    if len({d.name for d in definitions}) < len(definitions):
        raise ValueError("window names must be unique")
    kept = [c for c in events.columns]
    one = lambda d: F.struct(*observed(position, d))
    seen = events.select(*kept, F.explode(F.array(*[one(d) for d in definitions])).alias("__o")).select("__o.*").where("key is not null")
    return record(seen)


def transitions(windows: DataFrame) -> DataFrame:
    """Opened and Closed emissions."""
    base = [*("window_name", *LANE)]
    opened = windows.select(*base, F.col("start_position").alias("position"), F.lit("Opened").alias("kind"), "record_id")
    closed = windows.where("end_position is not null").select(*base, F.col("end_position").alias("position"), F.lit("Closed").alias("kind"), "record_id")
    return opened.unionByName(closed)


def stabilise(obs: DataFrame, enter_after: int = 1, exit_after: int = 1) -> DataFrame:
    """Debounce where the exit predicate is the negation of the enter one: run lengths of equal observations; a run confirms at
    its Nth observation. Returns the observations with `active` as confirmed."""
    w = Window.partitionBy("window_name", *LANE).orderBy("pos")
    run = F.sum(F.when(F.col("active").eqNullSafe(F.lag("active").over(w)), 0).otherwise(1)).over(w)
    nth = F.row_number().over(Window.partitionBy("window_name", *LANE, "run").orderBy("pos"))
    mark = F.when(F.col("active") & (F.col("nth") == enter_after), True).when(~F.col("active") & (F.col("nth") == exit_after), False)
    state = F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return obs.withColumn("run", run).withColumn("nth", nth).withColumn("mark", mark).withColumn("active", F.coalesce(state, F.lit(False))).drop("run", "nth", "mark")


def stabilise_two(obs: DataFrame, enter: str, leave: str, enter_after: int = 1, exit_after: int = 1) -> DataFrame:
    """Debounce with independent enter and exit predicates (they may hold together): each lane is passed through once, in order,
    a batch at a time; what is held is a lane's state. A null predicate does not hold."""
    lane = ["window_name", *LANE]
    out = obs.drop("active")
    schema = StructType([*out.schema.fields, StructField("active", BooleanType())])

    def run(batches):
        now, on, n = None, False, 0
        for b in batches:
            got = []
            for *k, a, z in zip(*(b.column(c).to_pylist() for c in (*lane, enter, leave))):
                if k != now:
                    now, on, n = k, False, 0
                n = n + 1 if (z if on else a) else 0
                if n and n >= (exit_after if on else enter_after):
                    on, n = not on, 0
                got.append(on)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.bool_())], names=[*b.schema.names, "active"])

    return out.repartition(*lane).sortWithinPartitions(*lane, "pos").mapInArrow(run, schema)


def roll_up(child: DataFrame, name: str, parent: Column, rule: Callable[[Column, Column], Column], segments: bool = False) -> DataFrame:
    """Windows of parents from observations of children: `rule(active children, known children)`. A child that moves to
    another parent leaves the old one first. Returns windows; see parent_observations for further levels and segments."""
    return record(parent_observations(child, name, parent, rule, segments), ("context",) if segments else ())


def any_active(active: Column, total: Column) -> Column:
    return active > 0


def all_active(active: Column, total: Column) -> Column:
    return (total > 0) & (active == total)


def parent_observations(child: DataFrame, name: str, parent: Column, rule, segments: bool = False) -> DataFrame:
    """One observation of a parent for every change that reaches it, with `active` by the rule, ready for another level.

    segments: parents have a state for each segment context of their children (see project_segments for what they see of it);
    an inactive child is in the empty context. A child that moves to another parent or context leaves the old one first. The
    observations then carry `context`, for record(context=("context",))."""
    ctx = F.when(F.col("active"), F.col("segments")).otherwise(F.slice("segments", 1, 0)) if segments else F.slice("segments", 1, 0)
    c = child.withColumn("ctx", ctx).withColumn("scope", F.struct(parent.cast("string").alias("p"), F.col("ctx").alias("ctx"))).where(parent.isNotNull())
    w = Window.partitionBy("window_name", *LANE).orderBy("pos")
    c = c.withColumn("was_scope", F.lag("scope").over(w)).withColumn("was", F.lag("active").over(w))
    num = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    moved = F.col("was_scope").isNotNull() & ~F.col("was_scope").eqNullSafe(F.col("scope"))
    known = F.col("was_scope").isNotNull() & ~moved
    rows = F.array(F.when(moved, F.struct(F.col("was_scope").alias("o"), F.lit(0).alias("seq"), (-num(F.col("was"))).alias("da"), F.lit(-1).alias("dt"))),
                   F.struct(F.col("scope").alias("o"), F.lit(1).alias("seq"), (num(F.col("active")) - F.when(known, num(F.col("was"))).otherwise(F.lit(0))).alias("da"), F.when(known, 0).otherwise(1).alias("dt")))
    d = c.select("pos", "source", "partition_id", "time", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("pos", "source", "partition_id", "time", "r.*")
    d = d.select("pos", "source", "partition_id", "time", F.col("o.p").alias("p"), F.col("o.ctx").alias("ctx"), F.to_json("o.ctx").alias("context"), "seq", "da", "dt")
    run = Window.partitionBy("p", "context", "source", "partition_id").orderBy("pos", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("a", F.sum("da").over(run)).withColumn("t", F.sum("dt").over(run))
    tags = F.array().cast("array<struct<name:string,value:string>>")
    return d.select("pos", F.lit(name).alias("window_name"), F.col("p").alias("key"), "source", "partition_id", rule(F.col("a"), F.col("t")).alias("active"), F.col("ctx").alias("segments"), tags.alias("tags"), "time", *(["context"] if segments else []))


def project_segments(obs: DataFrame, keep: list[str] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None, transform: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Preserve, drop, rename or transform the segments that a parent sees; parents that are gone become null; two segments of
    one projected name fail the query."""
    rename, transform = rename or {}, transform or {}
    s = F.filter("segments", lambda x: (x["name"].isin(*keep) if keep else F.lit(True)) & ~(x["name"].isin(*drop) if drop else F.lit(False)))
    new = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in rename.items() for v in kv]), c), c) if rename else c

    def value(x):
        out = x["value"]
        for n, fn in transform.items():
            out = F.when(x["name"] == n, fn(x["value"]).cast("string")).otherwise(out)
        return out

    names = F.transform(s, lambda x: x["name"])
    made = F.transform(s, lambda x: F.struct(new(x["name"]).alias("name"), value(x).alias("value"), F.when(F.array_contains(names, x["parent_name"]), new(x["parent_name"])).alias("parent_name")))
    twice = F.size(F.array_distinct(F.transform(made, lambda x: x["name"]))) < F.size(made)
    return obs.withColumn("segments", F.when(twice, F.raise_error(F.lit("two segments of one projected name")).cast("array<struct<name:string,value:string,parent_name:string>>")).otherwise(made))


def trim_closed_before(windows: DataFrame, position: int) -> DataFrame:
    return windows.where(F.col("end_position").isNull() | (F.col("end_position") > position))
