"""Comparison plans: what is compared, how ranges are made comparable, which comparators run. Plans are checked on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.temporal import ticks


def _is(name, value):
    return lambda s: (s["name"] == name) & (s["value"] == value)


@dataclass(frozen=True)
class Selector:
    """A predicate on windows. `spec` is its portable form; without one, a plan with it cannot be exported."""

    name: str
    predicate: Column
    spec: dict | None = None
    cohort: "Cohort | None" = None

    @property
    def serialisable(self) -> bool:
        return self.spec is not None

    def with_name(self, name: str) -> "Selector":
        return replace(self, name=name)

    def _both(self, other: "Selector", op: str) -> dict | None:
        return {op: [self.spec, other.spec]} if self.serialisable and other.serialisable else None

    def __and__(self, other: "Selector") -> "Selector":
        if self.cohort and other.cohort:
            raise ValueError("a cohort can be combined once")
        return Selector(f"({self.name} and {other.name})", self.predicate & other.predicate, self._both(other, "and"), self.cohort or other.cohort)

    def __or__(self, other: "Selector") -> "Selector":
        if self.cohort or other.cohort:
            raise ValueError("a cohort cannot be an alternative")
        return Selector(f"({self.name} or {other.name})", self.predicate | other.predicate, self._both(other, "or"))


def for_window(name):
    return Selector(f"window={name}", F.col("window_name") == name, {"window": name})


def for_key(key):
    return Selector(f"key={key}", F.col("key") == str(key), {"key": str(key)})


def for_source(source):
    return Selector(f"source={source}", F.col("source") == source, {"source": source})


def for_sources(sources):
    return Selector("sources=" + ",".join(sources), F.col("source").isin(*sources), {"sources": list(sources)})


def for_partition(p):
    return Selector(f"partition={p}", F.col("partition_id").eqNullSafe(p), {"partition": p})


def for_position_range(start, end=None):
    c = F.col("start_position") >= start
    return Selector(f"start in [{start},{'' if end is None else end})", c if end is None else c & (F.col("start_position") < end), {"positions": [start, end]})


def for_time_range(start, end=None):
    """Windows that start at or after `start` and before `end` (100 ns units since the epoch); without a start time: none."""
    at = ticks("start_time")
    c = at.isNotNull() & (at >= start)
    return Selector(f"time in [{start},{'' if end is None else end})", c if end is None else c & (at < end), {"times": [start, end]})


def runtime_only(name, predicate: Column):
    return Selector(name, predicate)


def from_spec(spec: dict) -> Selector:
    """The selector of a portable form."""
    if not isinstance(spec, dict) or not spec:
        raise ValueError("a selector is an object")
    made = {"window": for_window, "key": for_key, "source": for_source, "sources": for_sources, "partition": for_partition, "positions": lambda v: for_position_range(*v), "times": lambda v: for_time_range(*v),
            "cohort": lambda v: for_cohort(v["sources"], v["activity"], v.get("count")), "and": lambda v: from_spec(v[0]) & from_spec(v[1]), "or": lambda v: from_spec(v[0]) | from_spec(v[1])}
    (kind, value), *more = spec.items()
    if more or kind not in made:
        raise ValueError(f"unknown selector {spec}")
    return made[kind](value)


@dataclass(frozen=True)
class Cohort:
    """Whether the against side is active, by its number of distinct active sources."""

    sources: tuple[str, ...]
    activity: str = "any"
    count: int | None = None

    def __post_init__(self):
        if not self.sources or len(set(self.sources)) < len(self.sources):
            raise ValueError("cohort sources must be given and unique")
        if self.activity in ("at-least", "at-most", "exactly") and (self.count is None or not 0 <= self.count <= len(self.sources)):
            raise ValueError("the count must be between 0 and the number of members")
        if self.activity not in ("any", "all", "none", "at-least", "at-most", "exactly"):
            raise ValueError(f"unknown activity {self.activity}")

    def rule(self, n: Column) -> Column:
        return {"any": n >= 1, "all": n == len(self.sources), "none": n == 0, "at-least": n >= (self.count or 0), "at-most": n <= (self.count or 0), "exactly": n == (self.count or 0)}[self.activity]


def for_cohort(sources, activity="any", count=None) -> Selector:
    c = Cohort(tuple(sources), activity, count)
    return Selector(f"cohort {activity} of {','.join(sources)}", F.col("source").isin(*sources), {"cohort": {"sources": list(sources), "activity": activity, "count": count}}, c)


SIMPLE = ("overlap", "residual", "missing", "coverage", "gap", "symmetric-difference", "containment")
_LEAD = re.compile(r"lead-lag:(Start|End):(\w+):(\d+)")
_ASOF = re.compile(r"asof:(Previous|Next|Nearest):(\w+):(\d+)")


def parse_comparator(text: str) -> tuple:
    if text in SIMPLE:
        return (text,)
    if m := _LEAD.fullmatch(text):
        return ("lead-lag", m[1], m[2], int(m[3]))
    if m := _ASOF.fullmatch(text):
        return ("asof", m[1], m[2], int(m[3]))
    raise ValueError(f"unknown comparator {text}")


@dataclass(frozen=True)
class Diagnostic:
    code: str
    error: bool
    message: str = ""


@dataclass(frozen=True)
class Plan:
    name: str
    target: Selector
    against: tuple[Selector, ...]
    comparators: tuple[str, ...]
    scope_window: str | None = None
    scope_segments: tuple[tuple[str, str], ...] = ()
    scope_tags: tuple[tuple[str, str], ...] = ()
    axis: str = "position"
    horizon: int | None = None
    known_at: int | None = None
    duplicates: str = "preserve"
    coalesce: bool = False
    strict: bool = False
    use_segments: bool = True
    missing_time: str = "reject"
    availability: str = "position"

    def __post_init__(self):
        object.__setattr__(self, "comparators", tuple(dict.fromkeys(self.comparators)))

    @property
    def cohort(self) -> Cohort | None:
        return self.against[0].cohort if len(self.against) == 1 else None

    def live(self, horizon: int) -> "Plan":
        return replace(self, horizon=horizon)

    def against_predicate(self) -> Column:
        c = self.against[0].predicate
        for s in self.against[1:]:
            c = c | s.predicate
        return c

    def scope(self) -> Column:
        c = F.lit(True) if self.scope_window is None else F.col("window_name") == self.scope_window
        for col, pairs in (("segments", self.scope_segments), ("tags", self.scope_tags)):
            for n, v in pairs:
                c = c & F.exists(col, _is(n, v))
        return c

    def validate(self) -> list[Diagnostic]:
        out = []
        if not self.against:
            out.append(Diagnostic("MissingAgainst", True))
        if not self.comparators:
            out.append(Diagnostic("MissingComparator", True))
        for c in self.comparators:
            try:
                kind = parse_comparator(c)
                if kind[0] == "asof" and self.known_at is None:
                    out.append(Diagnostic("FutureLeakageRisk", self.strict, c))
            except ValueError:
                out.append(Diagnostic("UnknownComparator", True, c))
        if self.scope_window is None and not self.scope_segments and not self.scope_tags:
            out.append(Diagnostic("BroadSelector", self.strict))
        if not all(s.serialisable for s in (self.target, *self.against)):
            out.append(Diagnostic("NonSerializablePlan", self.strict))
        if self.axis not in ("position", "timestamp"):
            out.append(Diagnostic("UnknownAxis", True, self.axis))
        for field_, known in (("duplicates", ("preserve", "reject")), ("missing_time", ("reject", "exclude")), ("availability", ("position", "record"))):
            if getattr(self, field_) not in known:
                out.append(Diagnostic("UnknownPolicy", True, field_))
        if self.known_at is not None and self.horizon is not None and self.known_at < 0:
            out.append(Diagnostic("InvalidKnownAt", True))
        return out

    def fingerprint(self) -> str:
        """Equal for plans that differ in horizon and known-at alone."""
        parts = [self.target.name, [s.name for s in self.against], list(self.comparators), self.scope_window, self.scope_segments, self.scope_tags, self.axis, self.duplicates, self.coalesce, self.use_segments]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def to_json(self) -> str:
        """A document that from_json reads back: everything but runtime-only selectors, which it refuses."""
        if not all(s.serialisable for s in (self.target, *self.against)):
            raise ValueError("a plan with runtime-only selectors cannot be exported")
        one = lambda s: {"name": s.name, "select": s.spec}
        pairs = lambda p: [{"name": n, "value": v} for n, v in p]
        return json.dumps({"format": FORMAT, "version": 1, "name": self.name, "target": one(self.target), "against": [one(s) for s in self.against], "comparators": list(self.comparators),
                           "scope": {"window": self.scope_window, "segments": pairs(self.scope_segments), "tags": pairs(self.scope_tags)}, "axis": self.axis, "horizon": self.horizon, "knownAt": self.known_at,
                           "duplicates": self.duplicates, "coalesce": self.coalesce, "strict": self.strict, "useSegments": self.use_segments, "missingTime": self.missing_time, "availability": self.availability}, indent=2)

    @staticmethod
    def from_json(text: str) -> "Plan":
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("format") != FORMAT or d.get("version") != 1:
            raise ValueError("not a comparison plan of this version")
        unknown = set(d) - {"format", "version", "name", "target", "against", "comparators", "scope", "axis", "horizon", "knownAt", "duplicates", "coalesce", "strict", "useSegments", "missingTime", "availability"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        one = lambda x: from_spec(x["select"]).with_name(x["name"])
        pairs = lambda p: tuple((x["name"], x["value"]) for x in p or [])
        scope = d.get("scope") or {}
        return Plan(d["name"], one(d["target"]), tuple(one(x) for x in d["against"]), tuple(d["comparators"]), scope.get("window"), pairs(scope.get("segments")), pairs(scope.get("tags")), d.get("axis", "position"), d.get("horizon"), d.get("knownAt"),
                    d.get("duplicates", "preserve"), d.get("coalesce", False), d.get("strict", False), d.get("useSegments", True), d.get("missingTime", "reject"), d.get("availability", "position"))


FORMAT = "tidemark.comparison-plan"

__all__ = [k for k in globals() if not k.startswith("_") and k != "field"]
