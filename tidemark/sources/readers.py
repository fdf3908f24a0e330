"""Sources and sinks: flat window JSON Lines, event import maps over JSON Lines and CSV, result exports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.record import WindowDefinition, record_families, record_id

PAIR = "array<struct<name:string,value:string,parentName:string>>"


def read_windows(spark: SparkSession, path: str, default_name: str | None = None) -> DataFrame:
    """Flat windows; a missing or null end is open; the default name stands in for a missing one."""
    raw = spark.read.schema(f"windowName string, key string, source string, partition string, startPosition long, endPosition long, knownAt long, segments {PAIR}, tags array<struct<name:string,value:string>>").option("mode", "FAILFAST").json(path)
    name = F.coalesce("windowName", F.lit(default_name).cast("string"))
    none = F.array()
    return raw.select(name.alias("window_name"), "key", "source", F.col("partition").alias("partition_id"), F.col("startPosition").alias("start_position"), F.col("endPosition").alias("end_position"), F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"),
                      F.coalesce(F.transform("segments", lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"), s["parentName"].alias("parent_name"))), none.cast("array<struct<name:string,value:string,parent_name:string>>")).alias("segments"), F.coalesce("tags", none.cast("array<struct<name:string,value:string>>")).alias("tags"),
                      record_id(name, "key", "source", "partition", "startPosition").alias("record_id"), F.col("knownAt").alias("known_at"))


def write_windows(windows: DataFrame, path: str) -> None:
    windows.select(F.col("window_name").alias("windowName"), "key", "source", F.col("partition_id").alias("partition"), F.col("start_position").alias("startPosition"), F.col("end_position").alias("endPosition"),
                   F.transform("segments", lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"), s["parent_name"].alias("parentName"))).alias("segments"), "tags").write.json(path)


def path_of(field: str) -> str:
    """A dotted path, one with [n], or a JSON pointer, as a JSONPath."""
    if field.startswith("/"):
        parts = [p.replace("~1", "/").replace("~0", "~") for p in field[1:].split("/")]
        return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)
    return "$" + "".join(f"['{n}']" + "".join(f"[{i}]" for i in re.findall(r"\[(\d+)\]", rest)) for n, rest in re.findall(r"([^.\[\]]+)((?:\[\d+\])*)", field))


def predicate(value: Column, spec: dict) -> Column:
    """Exactly one of equals, notEquals, greaterThan(OrEqual), lessThan(OrEqual), isTrue, isFalse."""
    ops = [k for k in spec if k != "field"]
    if len(ops) != 1:
        raise ValueError("a predicate has exactly one operator")
    op, arg = ops[0], spec[ops[0]]
    if op in ("equals", "notEquals"):
        text = {True: "true", False: "false"}.get(arg, str(arg)) if isinstance(arg, bool) else str(arg)
        same = value.try_cast("double") == float(arg) if isinstance(arg, (int, float)) and not isinstance(arg, bool) else value == text
        return same if op == "equals" else ~same
    num = value.try_cast("double")
    known = {"greaterThan": lambda: num > arg, "greaterThanOrEqual": lambda: num >= arg, "lessThan": lambda: num < arg, "lessThanOrEqual": lambda: num <= arg, "isTrue": lambda: value == "true", "isFalse": lambda: value == "false"}
    if op not in known:
        raise ValueError(f"unknown operator {op}")
    return known[op]()


def import_events(events: DataFrame, mapping: dict, get=None, order: str | None = None) -> DataFrame:
    """Windows of raw events by an import map. events: one JSON document a row in `value`, or named CSV columns. A field that
    a row lacks fails the job; open windows stay open. `order`: a
    column by which positions must not move backwards within a source and partition."""
    if get is None:
        get = (lambda f: F.get_json_object("value", path_of(f))) if "value" in events.columns and mapping.get("input", "jsonl") == "jsonl" else (lambda f: F.col(f"`{f}`"))
    need = lambda f: F.coalesce(get(f), F.raise_error(F.lit(f"missing field {f}")).cast("string"))
    defs = []
    for w in mapping["windows"]:
        defs.append(WindowDefinition(w["name"], predicate(need(w["active"]["field"]), w["active"]), need(w.get("key") or mapping["key"]), need(mapping["source"]), need(mapping["partition"]) if mapping.get("partition") else None,
                                     {s["name"]: need(s["field"]) for s in w.get("segments", [])}, {s["name"]: s["parentName"] for s in w.get("segments", []) if s.get("parentName")}, {t["name"]: need(t["field"]) for t in w.get("tags", [])}))
    position = need(mapping["position"]).cast("long")
    if order is not None:
        lane = Window.partitionBy(need(mapping["source"]), *([need(mapping["partition"])] if mapping.get("partition") else [])).orderBy(order)
        events = events.withColumn("__pos", position)
        back = F.col("__pos") < F.lag("__pos").over(lane)
        events = events.withColumn("__pos", F.when(back, F.raise_error(F.lit("a position moves backwards")).cast("long")).otherwise(F.col("__pos")))
        position = F.col("__pos")
    return record_families(events, position, defs)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if any(not c.strip() for c in df.columns) or len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("headers must be unique and not blank")
    return df


def export_json_lines(rows: dict[str, DataFrame], path: str, plan=None) -> None:
    """One JSON document a row, written by the executors: first a summary line with the rows of every family, then the families
    in their order, each row with its finality. A summary and each family are a part of their own, in order of name."""
    spark = next(iter(rows.values())).sparkSession
    summary = {"kind": "summary", "plan": None if plan is None else plan.name, "rows": {n: df.count() for n, df in rows.items()}}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{path}/00-summary")
    for i, (name, df) in enumerate(rows.items(), 1):
        df.select(F.to_json(F.struct(F.lit(name).alias("comparator"), *df.columns)).alias("value")).write.text(f"{path}/{i:02d}-{name.replace(':', '-')}")


def export_markdown(plan, rows: dict[str, DataFrame], limit: int = 20) -> str:
    """Counts and the first rows of every family."""
    out = [f"# {plan.name}", "", f"Target {plan.target.name}; against {', '.join(s.name for s in plan.against)}.", ""]
    for name, df in rows.items():
        top = df.limit(limit).collect()
        out += [f"## {name}: {df.count()} rows", ""]
        if top:
            out += ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(str(v) for v in r) + " |" for r in top], ""]
    return "\n".join(out)


def redacted(rows: dict[str, DataFrame]) -> str:
    """Counts and finality only."""
    return json.dumps({n: {r["finality"]: r["count"] for r in df.groupBy("finality").count().collect()} if "finality" in df.columns else {"rows": df.count()} for n, df in rows.items()})
