"""python -m tidemark COMMAND: exit 0 fine, 1 invalid or failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.plans import comparison as plans


def load(path):
    with open(path) as f:
        return json.load(f)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").getOrCreate()


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate-plan", "compare", "explain"):
        sub.add_parser(name).add_argument("fixture")
    a = sub.add_parser("audit-windows")
    a.add_argument("windows")
    a.add_argument("--target", required=True)
    a.add_argument("--against", required=True, action="append")
    a.add_argument("--window")
    a.add_argument("--horizon", type=int)
    a.add_argument("--comparator", action="append")
    a.add_argument("--out")
    a.add_argument("--profile", choices=("Full", "Redacted"), default="Full")
    for name in ("timeline", "context"):
        sub.add_parser(name).add_argument("fixture")
    u = sub.add_parser("suite")
    u.add_argument("fixture")
    u.add_argument("suite")
    c = sub.add_parser("check")
    c.add_argument("fixture")
    c.add_argument("assessment")
    e = sub.add_parser("episodes")
    e.add_argument("document")
    e.add_argument("windows")
    e.add_argument("--format", choices=("rows", "json", "markdown"), default="rows")
    i = sub.add_parser("import-events")
    i.add_argument("events")
    i.add_argument("map")
    i.add_argument("out")
    sub.add_parser("verify-bundle").add_argument("path")
    d = sub.add_parser("diff")
    d.add_argument("previous")
    d.add_argument("current")
    o = p.parse_args(argv)

    from tidemark.sources import documents, readers

    if o.command == "verify-bundle":
        bad = documents.verify_bundle(o.path)
        print("\n".join(bad) or "whole")
        return int(bool(bad))
    if o.command == "diff":
        print(json.dumps(documents.diff(load(o.previous), load(o.current)), indent=2))
        return 0
    spark = session()
    if o.command == "validate-plan":
        found = documents.plan_of(load(o.fixture)["plan"]).validate()
        print(json.dumps([{"code": x.code, "error": x.error} for x in found]))
        return int(any(x.error for x in found))
    if o.command in ("compare", "explain"):
        doc = load(o.fixture)
        got = documents.run_fixture(spark, doc)
        plan = documents.plan_of(doc["plan"])
        print(readers.export_markdown(plan, got["rows"]) if o.command == "explain" else json.dumps(documents.result_document(plan, got["valid"], got["diagnostics"], got["rows"]), indent=2))
        return int(not (got["valid"] and got["matches"]))
    if o.command in ("timeline", "context", "suite"):
        from tidemark.operators import compare, governance
        from tidemark.sources import reports

        doc = load(o.fixture)
        c = compare.Comparison(documents.windows_of(spark, doc["windows"]), documents.plan_of(doc["plan"]))
        if o.command != "suite":
            print(reports.timeline_html(c) if o.command == "timeline" else reports.agent_context(c))
            return 0
        d = load(o.suite)
        got = [r.asDict() for r in governance.Suite(d["name"], tuple((x["name"], tuple(documents.rules_of(x))) for x in d["specifications"])).results(c).collect()]
        print(json.dumps({"passed": all(r["passed"] for r in got), "specifications": got}, indent=2))
        return int(not all(r["passed"] for r in got))
    if o.command == "check":
        from tidemark.operators import compare, governance

        doc = load(o.fixture)
        c = compare.Comparison(documents.windows_of(spark, doc["windows"]), documents.plan_of(doc["plan"]))
        bad = [r.asDict() for r in governance.assess(c, documents.rules_of(load(o.assessment))).toLocalIterator()]
        print(json.dumps({"passed": not bad, "violations": bad}, indent=2))
        return int(bool(bad))
    if o.command == "audit-windows":
        from tidemark.operators import compare

        w = readers.read_windows(spark, o.windows, o.window)
        plan = plans.Plan("audit", plans.for_source(o.target), tuple(plans.for_source(s) for s in o.against), tuple(o.comparator or ("overlap", "residual", "coverage")), o.window, horizon=o.horizon)
        from tidemark.sources import reports

        files = reports.bundle_files(compare.Comparison(w, plan), o.profile)
        if o.out:
            documents.write_bundle(o.out, files)
        else:
            sys.stdout.writelines(files["result.json"] if o.profile == "Full" else [files["context.json"], "\n"])
        return 0
    if o.command == "episodes":
        doc = load(o.document)
        w = readers.read_windows(spark, o.windows, doc["windowName"])
        if o.format != "rows":
            sys.stdout.writelines((documents.episodes_json if o.format == "json" else documents.episodes_markdown)(spark, doc, w))
            return 0
        got = documents.run_episodes(spark, doc, w)
        print(json.dumps(documents.rows_json(got), indent=2))
        return 0
    m = load(o.map)
    raw = readers.read_csv(spark, o.events) if m["input"] == "csv" else spark.read.text(o.events)
    readers.write_windows(readers.import_events(raw, m), o.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
