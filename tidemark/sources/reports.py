"""Documents for people and agents, rendered on the driver from a stated number of rows."""

from __future__ import annotations

import html
import json

from pyspark.sql import functions as F

from tidemark.operators import governance

COLOURS = {"target": "#2f6f9f", "against": "#b5651d"}


def timeline_html(comparison, limit: int = 500) -> str:
    """A page of its own: the normalised windows of both sides as bars, the first `limit` in order of lane and start, and the
    row counts of every comparator over all rows."""
    rows = comparison.norm.orderBy("window_name", "key", "partition_id", "side", "start_m", "end_m", "record_id").limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    low, high = min((r.start_m for r in rows), default=0), max((r.end_m for r in rows), default=1)
    scale = 800 / max(high - low, 1)
    lanes = list(dict.fromkeys((r.window_name, r.key, r.partition_id, r.side) for r in rows))
    bars = []
    for y, lane in enumerate(lanes):
        bars.append(f'<text x="4" y="{y * 22 + 15}">{html.escape(" / ".join("-" if x is None else str(x) for x in lane))}</text>')
        for r in rows:
            if (r.window_name, r.key, r.partition_id, r.side) == lane:
                bars.append(f'<rect x="{260 + (r.start_m - low) * scale:.1f}" y="{y * 22 + 3}" width="{max((r.end_m - r.start_m) * scale, 1):.1f}" height="15" fill="{COLOURS[r.side]}"><title>{html.escape(r.record_id)} [{r.start_m}, {r.end_m})</title></rect>')
    counts = "".join(f"<tr><td>{html.escape(c)}</td><td>{df.count()}</td></tr>" for c, df in comparison.run().items())
    note = f"<p>The first {limit} windows.</p>" if more else ""
    return (f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(comparison.plan.name)}</title></head><body><h1>{html.escape(comparison.plan.name)}</h1>{note}'
            f'<svg width="1080" height="{max(len(lanes), 1) * 22}" font-family="monospace" font-size="12">{"".join(bars)}</svg><table>{counts}</table></body></html>')


def agent_context(comparison, limit: int = 50) -> str:
    """What was asked, what was found, in JSON: the plan, coverage, row counts, the first rows of every comparator."""
    from tidemark.sources.documents import rows_json

    rows = comparison.run()
    cover = [r.asDict() for r in comparison.coverage_summary().orderBy("window_name", "key", "partition_id").limit(limit).collect()]
    return json.dumps({"rowsShownPerComparator": limit, "plan": json.loads(comparison.plan.to_json()), "diagnostics": [d.code for d in comparison.plan.validate()], "counts": {c: df.count() for c, df in rows.items()}, "coverage": cover, "rows": rows_json(rows, limit)}, indent=2)


def redacted_context(comparison, found: list[str] = (), limit: int = 1000) -> str:
    """Counts, diagnostic codes, row ids and finality; no key, source, segment or position. Says how many rows it leaves out."""
    ids = governance.identified(comparison)
    counts = {f"{r.comparator}/{r.finality}": r["count"] for r in ids.groupBy("comparator", "finality").count().collect()}
    rows = [r.asDict() for r in ids.orderBy("comparator", "row_id").limit(limit).collect()]
    return json.dumps({"counts": dict(sorted(counts.items())), "diagnostics": sorted(found), "rowsLeftOut": max(0, sum(counts.values()) - len(rows)), "rows": rows}, indent=2)


def result_pieces(comparison):
    """The whole result as JSON, row by row."""
    from tidemark.sources import documents

    rows = comparison.run()
    yield json.dumps({"format": documents.RESULT, "version": 1, "valid": True, "diagnostics": [d.code for d in comparison.plan.validate()], "fingerprint": comparison.plan.fingerprint(), "complete": True})[:-1] + ', "rows": {'
    for i, (name, df) in enumerate(rows.items()):
        yield ("," if i else "") + json.dumps(name) + ": ["
        df = df.orderBy(*[c for c in ("key", "start_m", "end_m") if c in df.columns])
        for j, r in enumerate(df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()):
            yield ("," if j else "") + "\n" + r[0]
        yield "]"
    yield "}}"


def bundle_files(comparison, profile: str = "Full", violations=None, traces=None) -> dict:
    """The documents of an audit bundle. Redacted: nothing but redacted_context and the fingerprint. Full: every row of the
    result, every violation, and the records behind the rows of `traces` (a comparator's name: rows), if given."""
    from tidemark.sources import readers

    if profile not in ("Full", "Redacted"):
        raise ValueError(f"unknown profile {profile}")
    bad = None if violations is None else [r.asDict() for r in violations.orderBy("rule", "evidence").toLocalIterator()]
    if profile == "Redacted":
        files = {"context.json": redacted_context(comparison, [d.code for d in comparison.plan.validate()]), "plan.json": json.dumps({"fingerprint": comparison.plan.fingerprint()})}
        return files if bad is None else files | {"assessment.json": json.dumps({"passed": not bad, "violations": [b["rule"] for b in bad]}, indent=2)}
    rows = comparison.run()
    files = {"result.json": result_pieces(comparison), "result.md": readers.export_markdown(comparison.plan, rows), "plan.json": comparison.plan.to_json(), "timeline.html": timeline_html(comparison)}
    for name, of in (traces or {}).items():
        files[f"trace-{name}.jsonl"] = (r[0] + "\n" for r in comparison.trace(of).select(F.to_json(F.struct("*"))).toLocalIterator())
    return files if bad is None else files | {"assessment.json": json.dumps({"passed": not bad, "violations": bad}, indent=2)}
