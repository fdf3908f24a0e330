"""Documents: contract fixtures, episode analyses, assessments, audit bundles and result diffs."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compare, episodes, governance
from tidemark.plans import comparison as plans

RESULT = "tidemark.comparison-result"
WINDOWS = "window_name string, key string, source string, partition_id string, start_position long, end_position long, start_time timestamp, end_time timestamp, segments array<struct<name:string,value:string,parent_name:string>>, tags array<struct<name:string,value:string>>, record_id string"


def text(value) -> str | None:
    """JSON values as canonical text: booleans in lower case, whole numbers without a point."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def windows_of(spark: SparkSession, rows: list[dict], default_name: str | None = None) -> DataFrame:
    """A document's own windows (as many as a document holds)."""
    out = []
    for n, w in enumerate(rows):
        segs = [(s["name"], text(s.get("value")), s.get("parentName")) for s in w.get("segments") or []]
        out.append((w.get("windowName") or default_name, text(w["key"]), text(w.get("source")), text(w.get("partition")), w["startPosition"], w.get("endPosition"), None, None, segs, [(t["name"], text(t.get("value"))) for t in w.get("tags") or []], f"window-{n + 1:04d}"))
    return spark.createDataFrame(out, WINDOWS)


def plan_of(d: dict) -> plans.Plan:
    cohort = d.get("againstCohort")
    against = (plans.for_cohort(cohort["sources"], cohort["activity"], cohort.get("count")),) if cohort else tuple(plans.for_source(s) for s in d["againstSources"])
    pairs = lambda k: tuple((x["name"], text(x["value"])) for x in d.get(k) or [])
    return plans.Plan(d["name"], plans.for_source(d["targetSource"]), against, tuple(d["comparators"]), d.get("scopeWindow"), pairs("scopeSegments"), pairs("scopeTags"), strict=bool(d.get("strict")), horizon=d.get("liveHorizonPosition"))


def _needs(doc, what: str, *fields: str) -> None:
    """A document is an object with these fields."""
    if not isinstance(doc, dict):
        raise ValueError(f"a {what} is an object")
    gone = [f for f in fields if f not in doc]
    if gone:
        raise ValueError(f"a {what} needs {', '.join(gone)}")


def check_fixture(doc: dict) -> None:
    """Refuses a fixture that lacks what it must have, or has a version that is not 1."""
    _needs(doc, "fixture", "windows", "plan")
    if doc.get("version", 1) != 1:
        raise ValueError("a fixture of another version")
    _needs(doc["plan"], "plan", "name", "targetSource", "comparators")
    if bool(doc["plan"].get("againstSources")) == bool(doc["plan"].get("againstCohort")):
        raise ValueError("a plan has either againstSources or againstCohort")
    for w in doc["windows"]:
        _needs(w, "window", "key", "startPosition")
        if w.get("endPosition") is not None and w["endPosition"] < w["startPosition"]:
            raise ValueError("a window ends before it starts")


def run_fixture(spark: SparkSession, doc: dict) -> dict:
    """{valid, diagnostics, rows, matches}: any error leaves no rows. matches: whether the numbers of rows in the fixture's
    `expected` (comparator: rows), if it has one, are those found."""
    check_fixture(doc)
    plan, windows = plan_of(doc["plan"]), windows_of(spark, doc["windows"])
    found = [(x.code, x.error) for x in plan.validate()]
    found += [(k, True) for k in compare.errors(windows, plan)]
    if any(e for _, e in found):
        return {"valid": False, "diagnostics": [c for c, _ in found], "rows": {}, "matches": doc.get("expected") in (None, {})}
    rows = compare.Comparison(windows, plan).run()
    return {"valid": True, "diagnostics": [c for c, _ in found], "rows": rows, "matches": all(n in rows and rows[n].count() == k for n, k in (doc.get("expected") or {}).items())}


def run_episodes(spark: SparkSession, doc: dict, windows: DataFrame) -> dict[str, DataFrame]:
    _needs(doc, "episode analysis", "windowName", "target", "against", "stitchTolerance", "relationTolerance")
    if min(doc["stitchTolerance"], doc["relationTolerance"]) < 0 or doc["target"]["source"] == doc["against"]["source"]:
        raise ValueError("tolerances are not negative, and the sides differ")
    w = windows.where(F.col("window_name") == doc["windowName"])
    args = (w, doc["target"]["source"], doc["against"]["source"], doc["stitchTolerance"], doc["relationTolerance"], doc.get("liveHorizon"))
    rel = episodes.relations(*args)
    metrics = episodes.metrics(*args)
    return {"relations": rel, "metrics": metrics, "scorecard": episodes.scorecard(rel), "summary": episodes.comparison_summary(rel, metrics)}


EPISODES = "tidemark.episode-result"


def _portable(spark: SparkSession, doc: dict, windows: DataFrame):
    """Sorted episodes and relations of an analysis, as JSON objects, one after another."""
    _needs(doc, "episode analysis", "name", "windowName", "target", "against", "stitchTolerance", "relationTolerance")
    if doc.get("version", 1) != 1 or min(doc["stitchTolerance"], doc["relationTolerance"], doc.get("liveHorizon") or 0) < 0 or doc["target"]["source"] == doc["against"]["source"]:
        raise ValueError("an episode analysis has version 1, tolerances and a horizon that are not negative, and two sides")
    w = windows.where(F.col("window_name") == doc["windowName"])
    made, related = episodes.portable(w, doc["target"]["source"], doc["against"]["source"], doc["stitchTolerance"], doc["relationTolerance"], doc.get("liveHorizon"))
    rows = lambda df, *order: (json.loads(r[0]) for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator())
    first = F.when(F.size("target") > 0, 0).otherwise(1)
    return rows(made, F.desc("side"), "index"), rows(related, first, "target", "against")


def episodes_json(spark: SparkSession, doc: dict, windows: DataFrame):
    """The pieces of a result document: episodes of both sides in portable order, and relations by their indexes; relations
    with a target come first, by its indexes."""
    made, related = _portable(spark, doc, windows)
    yield json.dumps({"format": EPISODES, "version": 1, "name": doc["name"]}, ensure_ascii=False)[:-1]
    for name, rows in (("episodes", made), ("relations", related)):
        yield f', "{name}": ['
        for i, r in enumerate(rows):
            yield ("," if i else "") + "\n" + json.dumps(r, ensure_ascii=False)
        yield "]"
    yield "}\n"


def episodes_markdown(spark: SparkSession, doc: dict, windows: DataFrame):
    """The same as text; keys and partitions are JSON literals, so a null partition is not the text "null"."""
    made, related = _portable(spark, doc, windows)
    one = lambda v: json.dumps(v, ensure_ascii=False).replace("|", "\\|")
    yield f"# {doc['name']}\n\n## Episodes\n\n| Side | Index | Key | Partition | Start | End | Fragments | Active | Finality |\n|-|-|-|-|-|-|-|-|-|\n"
    for r in made:
        yield f"| {r['side']} | {r['index']} | {one(r['key'])} | {one(r['partition_id'])} | {r['start_m']} | {r['end_m']} | {r['fragments']} | {r['active']} | {r['finality']} |\n"
    yield "\n## Relations\n\n| Kind | Target | Against | Finality |\n|-|-|-|-|\n"
    for r in related:
        yield f"| {r['kind']} | {', '.join(map(str, r['target']))} | {', '.join(map(str, r['against']))} | {r['finality']} |\n"


def rules_of(doc: dict) -> list[governance.Rule]:
    kind = {"minimumCoverage": ("minimum_coverage", "minimumRatio"), "maximumResidualMagnitude": ("maximum_residual", "maximumMagnitude"), "maximumGapMagnitude": ("maximum_gap", "maximumMagnitude"), "maximumAbsoluteLeadLag": ("maximum_lead_lag", "maximumMagnitude"), "requireFinalRows": ("require_final", ""),
            "allowedDiagnostics": ("allowed_diagnostics", "")}
    return [governance.Rule(r["id"], kind[r["type"]][0], r.get(kind[r["type"]][1], 0), r.get("aggregation", "single").capitalize(), tuple(r.get("allowedCodes") or ())) for r in doc["rules"]]


def rows_json(result: dict[str, DataFrame], limit: int | None = None) -> dict:
    """The rows of every family, in order; with a limit the first ones, which the caller has to say."""

    def one(df):
        df = df.orderBy(*[c for c in ("key", "start_m", "end_m") if c in df.columns])
        df = df if limit is None else df.limit(limit)
        return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()]

    return {n: one(df) for n, df in result.items()}


def result_document(plan: plans.Plan, valid: bool, found: list[str], rows: dict[str, DataFrame]) -> dict:
    """A whole result: every row of every family, for diff."""
    return {"format": RESULT, "version": 1, "valid": valid, "diagnostics": found, "fingerprint": plan.fingerprint(), "complete": True, "rows": rows_json(rows)}


def write_bundle(path: str, files: dict) -> None:
    """A directory of named documents with a manifest of sizes and SHA-256 sums; it appears whole or not at all. A document is
    text, or the pieces of one, which are written as they come: a result of any number of rows passes through."""
    tmp = tempfile.mkdtemp(prefix=".bundle-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        manifest = {}
        for name, body in files.items():
            size, digest = 0, hashlib.sha256()
            with open(os.path.join(tmp, name), "wb") as f:
                for piece in [body] if isinstance(body, str) else body:
                    data = piece.encode()
                    f.write(data)
                    digest.update(data)
                    size += len(data)
            manifest[name] = {"bytes": size, "sha256": digest.hexdigest()}
        with open(os.path.join(tmp, "manifest.json"), "w") as f:
            json.dump({"files": manifest}, f, indent=2)
        os.rename(tmp, path)
    except BaseException:
        shutil.rmtree(tmp, ignore_errors=True)
        raise


def read_bundle(path: str) -> dict[str, str]:
    """The documents of a whole bundle; one that verify_bundle finds wanting is refused."""
    bad = verify_bundle(path)
    if bad:
        raise ValueError("; ".join(bad))
    with open(os.path.join(path, "manifest.json")) as f:
        names = json.load(f)["files"]
    out = {}
    for n in names:
        with open(os.path.join(path, n)) as f:
            out[n] = f.read()
    return out


def verify_bundle(path: str) -> list[str]:
    """What is missing or differs from the manifest; nothing if the bundle is whole."""
    with open(os.path.join(path, "manifest.json")) as f:
        files = json.load(f)["files"]
    out = []
    for name, want in files.items():
        try:
            with open(os.path.join(path, name), "rb") as f:
                data = f.read()
        except FileNotFoundError:
            out.append(f"missing {name}")
            continue
        if len(data) != want["bytes"]:
            out.append(f"size of {name}")
        elif hashlib.sha256(data).hexdigest() != want["sha256"]:
            out.append(f"hash of {name}")
    return out


def diff(previous: dict, current: dict) -> list[dict]:
    """Rows added, revised (finality alone differs) and retracted between two exported results of one plan. Results that say
    they are not complete are refused, as rows they leave out would look retracted."""
    if not (previous.get("complete", True) and current.get("complete", True)):
        raise ValueError("a result that leaves out rows cannot be compared")
    if previous.get("fingerprint") != current.get("fingerprint"):
        raise ValueError("the results are of different plans")
    out = []
    for n in sorted({*previous["rows"], *current["rows"]}):
        a, b = ({json.dumps({k: v for k, v in r.items() if k != "finality"}, sort_keys=True): r for r in x["rows"].get(n, [])} for x in (previous, current))
        out += [{"comparator": n, "change": "Retracted", "row": a[r]} for r in sorted(set(a) - set(b))] + [{"comparator": n, "change": "Added", "row": b[r]} for r in sorted(set(b) - set(a))]
        out += [{"comparator": n, "change": "Revised", "row": b[r]} for r in sorted(set(a) & set(b)) if a[r].get("finality") != b[r].get("finality")]
    return out
