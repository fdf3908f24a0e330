"""Helpers for tests and tools: window fixtures, a virtual clock, pipeline metadata, extension descriptors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.history import duplicate_open, validate
from tidemark.operators.record import WindowDefinition

FORM = ("window_name string, key string, source string, partition_id string, start_position long, end_position long, start_time timestamp, end_time timestamp, "
        "segments array<struct<name:string,value:string,parent_name:string>>, tags array<struct<name:string,value:string>>, record_id string")


@dataclass
class FixtureBuilder:
    """Windows by hand: builder.closed("w", "k", 1, 5, source="a").open("w", "k", 7).build(spark)."""

    rows: list[tuple] = field(default_factory=list)

    def closed(self, window: str, key, start: int, end: int, source=None, partition=None, segments: dict | None = None, tags: dict | None = None) -> "FixtureBuilder":
        return self._add(window, key, start, end, source, partition, segments, tags)

    def open(self, window: str, key, start: int, source=None, partition=None, segments: dict | None = None, tags: dict | None = None) -> "FixtureBuilder":
        return self._add(window, key, start, None, source, partition, segments, tags)

    def _add(self, window, key, start, end, source, partition, segments, tags):
        pairs = lambda d, *more: [(n, None if v is None else str(v), *more) for n, v in (d or {}).items()]
        self.rows.append((window, str(key), source, partition, start, end, None, None, pairs(segments, None), pairs(tags), f"window-{len(self.rows) + 1:04d}"))
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        """The windows; broken records and second open windows of a lane are refused."""
        out = spark.createDataFrame(self.rows, FORM)
        bad = [f"{r.record_id}: {r.problem}" for r in validate(out).collect()] + [f"{r.window_name}/{r.key}: open twice" for r in duplicate_open(out).collect()]
        if bad:
            raise ValueError("; ".join(bad))
        return out


@dataclass
class VirtualClock:
    """A horizon that a test moves forward."""

    now: int = 0

    def advance(self, by: int) -> int:
        return self.move_to(self.now + by)

    def move_to(self, position: int) -> int:
        if position < self.now:
            raise ValueError("a clock does not go back")
        self.now = position
        return position


def metadata(definitions: list[WindowDefinition], roll_ups: dict[str, str] | None = None) -> list[dict]:
    """The families of a pipeline as a tree: name, what it carries, and the roll-ups over it (name: child)."""
    roll_ups = roll_ups or {}
    below = lambda name: [{"name": n, "rollUps": below(n)} for n, child in roll_ups.items() if child == name]
    return [{"name": d.name, "segments": list(d.segments), "tags": list(d.tags), "hasSource": d.source is not None, "hasPartition": d.partition is not None, "hasEventTime": d.event_time is not None, "rollUps": below(d.name)} for d in definitions]


@dataclass(frozen=True)
class Extension:
    """Names that an extension declares; it carries no code."""

    name: str
    version: str = "1"
    selectors: tuple[str, ...] = ()
    comparators: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("an extension needs a name")
        for names in (self.selectors, self.comparators, [k for k, _ in self.metadata]):
            if len(set(names)) < len(names):
                raise ValueError("names of an extension are unique")
