"""Column helpers for points, half-open ranges and saturating magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, MIN = 2**63 - 1, -(2**63)


def saturating_subtract(a, b) -> Column:
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.coalesce(F.try_subtract(a, b), F.when(a.isNull() | b.isNull(), None).when(a < b, F.lit(MIN)).otherwise(F.lit(MAX)))


def saturating_add(a, b) -> Column:
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.coalesce(F.try_add(a, b), F.when(a.isNull() | b.isNull(), None).when(b < 0, F.lit(MIN)).otherwise(F.lit(MAX)))


def overlaps(s1, e1, s2, e2) -> Column:
    return (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))


def contains(s, e, p) -> Column:
    p = p if isinstance(p, Column) else F.col(p)
    return (F.col(s) <= p) & (p < F.col(e))


def is_empty(s, e) -> Column:
    return F.col(s) == F.col(e)


def ticks(ts) -> Column:
    """A timestamp as 100 ns units since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 10


AXES = ("position", "timestamp")


def point(magnitude, axis: str = "position", clock: str | None = None) -> Column:
    """A point: a struct of axis, clock (of timestamps; null: the default one) and m."""
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis}")
    m = F.col(magnitude) if isinstance(magnitude, str) else magnitude
    return F.struct(F.lit(axis).alias("axis"), F.lit(clock).cast("string").alias("clock"), m.cast("long").alias("m"))


def compare_points(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null for a null point. Points on different axes, and timestamps of different clocks, fail the query."""
    wrong = F.when(a["axis"] != b["axis"], "points on different axes").when((a["axis"] == "timestamp") & ~a["clock"].eqNullSafe(b["clock"]), "timestamps of different clocks")
    sign = F.when(a["m"] < b["m"], -1).when(a["m"] > b["m"], 1).when(a["m"] == b["m"], 0)
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(sign)


def closed(start: Column, end: Column) -> Column:
    """A half-open range of two points: a struct of start, end and status."""
    return F.struct(start.alias("start"), end.alias("end"), F.lit("Closed").alias("status"))


def unended(start: Column) -> Column:
    """A range without an end yet."""
    return F.struct(start.alias("start"), F.when(F.lit(False), start).alias("end"), F.lit("UnknownEnd").alias("status"))


def with_effective_end(start: Column, end: Column, status: str) -> Column:
    """A range that a horizon or a query's range ends."""
    if status not in ("OpenAtHorizon", "ClippedByQueryRange"):
        raise ValueError("an effective end comes of a horizon or of clipping")
    return F.struct(start.alias("start"), end.alias("end"), F.lit(status).alias("status"))


def _end(r: Column) -> Column:
    m = F.coalesce(r["end"]["m"], F.raise_error(F.lit("a range without an end")).cast("long"))
    return F.struct(r["end"]["axis"].alias("axis"), r["end"]["clock"].alias("clock"), m.alias("m"))


def range_length(r: Column, axis: str = "position") -> Column:
    """Saturating length of a range on its axis (100 ns units of timestamps); another axis or no end fails the query."""
    other = F.raise_error(F.lit(f"not a range on the {axis} axis")).cast("long")
    return F.when(r["start"]["axis"] == axis, saturating_subtract(_end(r)["m"], r["start"]["m"])).otherwise(other)


def range_holds(r: Column, p: Column) -> Column:
    return (compare_points(r["start"], p) <= 0) & (compare_points(p, _end(r)) < 0)


def ranges_overlap(a: Column, b: Column) -> Column:
    return (compare_points(a["start"], _end(b)) < 0) & (compare_points(b["start"], _end(a)) < 0)


def range_empty(r: Column) -> Column:
    return compare_points(r["start"], _end(r)) == 0


def canonical(value, kind: str = "string") -> Column:
    """Typed canonical text: equal only for equal type and text; null is <null>."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNull(), F.lit("<null>")).otherwise(F.concat(F.lit(kind + ":"), v.cast("string")))


def segment_value(segments, name: str) -> Column:
    return F.element_at(F.transform(F.filter(F.col(segments), lambda s: s["name"] == name), lambda s: s["value"]), 1)


def row_id(kind: str, *cols) -> Column:
    """Stable identity: the kind and a SHA-256 over length-prefixed parts."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.concat(F.lit(kind + ":"), F.sha2(F.concat_ws("|", *parts), 256))
