"""Changelogs, replay, assessments, suites, revisions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.temporal import row_id, saturating_subtract
from tidemark.operators.compare import diagnostics


def changelog(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (row_id, finality[, version]) added, revised or retracted between two snapshots, by one full outer join."""
    p = previous.select("row_id", F.col("finality").alias("was"), (F.col("version") if "version" in previous.columns else F.lit(1)).alias("v"))
    c = current.select("row_id", F.col("finality").alias("now"))
    kind = F.when(F.col("was").isNull(), "Added").when(F.col("now").isNull(), "Retracted").when(~F.col("was").eqNullSafe(F.col("now")), "Revised")
    return p.join(c, "row_id", "full_outer").withColumn("change", kind).where("change is not null").select("row_id", "change", F.coalesce("now", "was").alias("finality"), F.when(F.col("change") == "Added", 1).otherwise(F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"))


def replay(previous: DataFrame, entries: DataFrame) -> DataFrame:
    """The snapshot after the entries: the latest version of every row that is not retracted."""
    p = previous.select("row_id", "finality", (F.col("version") if "version" in previous.columns else F.lit(1)).cast("int").alias("version"), F.lit("Kept").alias("change"))
    both = p.unionByName(entries.select("row_id", "finality", "version", "change"))
    w = Window.partitionBy("row_id").orderBy(F.desc("version"), F.col("change") == "Kept")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1 and change <> 'Retracted'").select("row_id", "finality", "version")


@dataclass(frozen=True)
class Rule:
    """minimum_coverage(ratio), maximum_residual / maximum_gap(limit, Single | Total), maximum_lead_lag(limit), require_final,
    allowed_diagnostics(codes)."""

    id: str
    kind: str
    limit: float = 0
    aggregation: str = "Single"
    codes: tuple[str, ...] = ()


def _violations(comparison, r: Rule) -> DataFrame | None:
    """rule, evidence of one rule, over rows of the plan's own comparators; None if it declares none that the rule is about."""
    plan, name = comparison.plan, F.lit(r.id).alias("rule")
    evidence = lambda *c: F.to_json(F.struct(*c)).alias("evidence")
    if r.kind == "minimum_coverage":
        if "coverage" not in plan.comparators:
            return None
        return comparison.coverage_summary().where(F.col("ratio") < r.limit).select(name, evidence("window_name", "key", "partition_id", "ratio"))
    if r.kind in ("maximum_residual", "maximum_gap"):
        family = r.kind.removeprefix("maximum_")
        if family not in plan.comparators:
            return None
        rows = comparison.rows(family).select("key", "start_m", "end_m", saturating_subtract("end_m", "start_m").alias("length"))
        if r.aggregation == "Total":
            rows = rows.agg(F.coalesce(F.sum(F.col("length").cast("decimal(38,0)")), F.lit(0)).alias("length"))
        return rows.where(F.col("length") > r.limit).select(name, evidence(*rows.columns))
    if r.kind == "maximum_lead_lag":
        leads = [c for c in plan.comparators if c.startswith("lead-lag")]
        if not leads:
            return None
        rows = reduce(DataFrame.unionByName, [comparison.rows(c).withColumn("comparator", F.lit(c)) for c in leads])
        return rows.where(F.col("delta").isNull() | (F.col("delta") > r.limit) | (F.col("delta") < -r.limit)).select(name, evidence("comparator", "record_id", "delta"))
    if r.kind == "require_final":
        return identified(comparison).where("finality <> 'Final'").select(name, evidence("comparator", "row_id"))
    if r.kind == "allowed_diagnostics":
        found = diagnostics(comparison.windows, plan)
        counted = [F.when(F.col(c) > 0, F.lit(c)) for c in found.columns]
        codes = F.array_compact(F.array(*counted, *[F.lit(d.code) for d in plan.validate()]))
        return found.select(name, F.explode(codes).alias("evidence")).where(~F.col("evidence").isin(*r.codes) if r.codes else F.lit(True))
    raise ValueError(f"unknown rule {r.kind}")


def assess(comparison, rules: list[Rule]) -> DataFrame:
    """One row per violation: rule, evidence. Empty: passed. A rule about rows that the plan has no comparator for passes."""
    if not rules or len({r.id for r in rules}) < len(rules):
        raise ValueError("an assessment needs rules with unique ids")
    found = [v for r in rules if (v := _violations(comparison, r)) is not None]
    return reduce(DataFrame.unionByName, found) if found else comparison.windows.sparkSession.createDataFrame([], "rule string, evidence string")


INVALID = "comparison.invalid"


def assess_findings(found: list[str], valid: bool, allowed: dict[str, set[str]]) -> list[dict]:
    """Violations known on the driver. allowed: rule id to the diagnostic codes it lets pass; an invalid comparison violates too."""
    out = [{"rule": r, "evidence": code} for r, codes in allowed.items() for code in sorted(set(found) - codes)]
    return out if valid else [*out, {"rule": INVALID, "evidence": ",".join(found)}]


@dataclass(frozen=True)
class Suite:
    """Named specifications over one comparison; it passes if all of them do."""

    name: str
    specifications: tuple[tuple[str, tuple[Rule, ...]], ...]

    def __post_init__(self):
        names = [n for n, _ in self.specifications]
        if not names or len(set(names)) < len(names):
            raise ValueError("a suite needs specifications with unique names")

    def assess(self, comparison) -> DataFrame:
        """specification, rule, evidence of every violation."""
        out = None
        for name, rules in self.specifications:
            one = assess(comparison, list(rules)).select(F.lit(name).alias("specification"), "rule", "evidence")
            out = one if out is None else out.unionByName(one)
        return out

    def results(self, comparison) -> DataFrame:
        """specification, violations, passed: one row for each, in the order given."""
        names = comparison.windows.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(self.specifications)], "ordinal int, specification string")
        n = self.assess(comparison).groupBy("specification").agg(F.count(F.lit(1)).alias("violations"))
        return names.join(n, "specification", "left").select("ordinal", "specification", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("violations").isNull().alias("passed")).orderBy("ordinal")


def identified(comparison) -> DataFrame:
    """comparator, row_id, finality of all rows of the plan's comparators."""
    out = None
    for name in comparison.plan.comparators:
        rows = comparison.rows(name)
        who = [c for c in rows.columns if c in ("window_name", "key", "partition_id", "ctx", "start_m", "end_m", "side", "record_id", "target_m", "against_m", "against_id") or (c == "status" and name == "containment")]
        one = rows.select(F.lit(name).alias("comparator"), row_id(name, *who).alias("row_id"), "finality")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the plan has no comparator")
    return out


def _delta(previous: DataFrame, current: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Rows of either side whose values differ; nulls in `by` are equal to each other."""
    p = previous.select(*[F.col(c).alias(f"p_{c}") for c in by], *[F.col(v).alias(f"previous_{v}") for v in values], F.lit(True).alias("p"))
    c = current.select(*by, *[F.col(v).alias(f"current_{v}") for v in values], F.lit(True).alias("c"))
    same = [F.col(f"p_{x}").eqNullSafe(F.col(x)) for x in by]
    differs = F.col("p").isNull() | F.col("c").isNull()
    for v in values:
        differs = differs | ~F.col(f"previous_{v}").eqNullSafe(F.col(f"current_{v}"))
    keys = [F.when(F.col("c"), F.col(x)).otherwise(F.col(f"p_{x}")).alias(x) for x in by]
    return p.join(c, same, "full_outer").where(differs).select(*keys, *[f"previous_{v}" for v in values], *[f"current_{v}" for v in values])


def revision(previous, current, rules: list[Rule] | None = None) -> dict[str, DataFrame]:
    """What changed between two runs of one plan (at other horizons, or over other windows): `rows` (Added, Revised,
    Retracted), `coverage`, `lead_lag` (for the plan's lead-lag comparators) and, given rules, `violations`."""
    if previous.plan.fingerprint() != current.plan.fingerprint():
        raise ValueError("the runs are of different plans")
    out = {"rows": changelog(identified(previous), identified(current)), "coverage": _delta(previous.coverage_summary(), current.coverage_summary(), ["window_name", "key", "partition_id"], ["target_magnitude", "covered_magnitude", "ratio"])}
    leads = [c for c in current.plan.comparators if c.startswith("lead-lag")]
    if leads:
        side = lambda x: reduce(DataFrame.unionByName, [x.rows(c).withColumn("comparator", F.lit(c)) for c in leads])
        out["lead_lag"] = _delta(side(previous), side(current), ["comparator", "record_id", "target_m"], ["against_id", "delta", "direction"])
    if rules:
        one = lambda x: assess(x, rules).groupBy("rule", "evidence").agg(F.count(F.lit(1)).alias("count"))
        out["violations"] = _delta(one(previous), one(current), ["rule", "evidence"], ["count"])
    return out
