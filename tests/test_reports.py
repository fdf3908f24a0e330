"""Suites, revisions and rendered documents."""

import json

import pytest

from tests.test_documents import fixture
from tidemark.__main__ import main
from tidemark.operators import compare, governance
from tidemark.operators.governance import Rule, Suite
from tidemark.sources import documents, reports


def comparison(spark, horizon=None, comparators=("overlap", "residual", "coverage", "containment", "lead-lag:Start:ProcessingPosition:2"), **change):
    doc = fixture(comparators=list(comparators))
    doc["windows"][1] |= change
    plan = documents.plan_of(doc["plan"])
    return compare.Comparison(documents.windows_of(spark, doc["windows"]), plan if horizon is None else plan.live(horizon))


def test_suite(spark):
    c = comparison(spark)
    s = Suite("s", (("loose", (Rule("r", "minimum_coverage", 0.2),)), ("tight", (Rule("r", "minimum_coverage", 0.9), Rule("q", "maximum_residual", 1)))))
    assert [(r.specification, r.violations, r.passed) for r in s.results(c).collect()] == [("loose", 0, True), ("tight", 2, False)]
    with pytest.raises(ValueError):
        Suite("s", ())
    assert governance.assess_findings(["A", "B"], False, {"d": {"A"}}) == [{"rule": "d", "evidence": "B"}, {"rule": governance.INVALID, "evidence": "A,B"}]


def test_revision(spark):
    same = governance.revision(comparison(spark), comparison(spark), [Rule("r", "minimum_coverage", 0.9)])
    assert {n: d.count() for n, d in same.items()} == {"rows": 0, "coverage": 0, "lead_lag": 0, "violations": 0}
    got = governance.revision(comparison(spark), comparison(spark, startPosition=2), [Rule("r", "minimum_coverage", 0.6)])
    cov = got["coverage"].collect()
    assert [(r.previous_ratio, r.current_ratio, r.partition_id) for r in cov] == [(0.5, 0.75, None)]
    assert {r.change for r in got["rows"].collect()} == {"Added", "Retracted"}
    assert [(r.previous_delta, r.current_delta) for r in got["lead_lag"].collect()] == [(-2, -1)]
    assert [(r.previous_count, r.current_count) for r in got["violations"].collect()] == [(1, None)]
    with pytest.raises(ValueError):
        governance.revision(comparison(spark), comparison(spark, comparators=["overlap"]))


def test_revised_finality(spark):
    early = comparison(spark, 6, ("overlap",), startPosition=3, endPosition=None)
    late = comparison(spark, 8, ("overlap",))
    assert [(r.change, r.finality) for r in governance.revision(early, late)["rows"].collect()] == [("Revised", "Final")]


def test_reports(spark):
    c = comparison(spark)
    page = reports.timeline_html(c)
    assert page.count("<rect") == 2 and "<td>overlap</td><td>1</td>" in page and "The first" not in page
    assert "The first 1 windows" in reports.timeline_html(c, 1)
    told = json.loads(reports.agent_context(c))
    assert told["counts"]["overlap"] == 1 and told["coverage"][0]["ratio"] == 0.5
    hidden = reports.redacted_context(c)
    assert json.loads(hidden)["counts"]["overlap/Final"] == 1 and not any(x in hidden for x in ('"k"', "start_m", '"a"'))
    files = reports.bundle_files(c, "Redacted", governance.assess(c, [Rule("r", "minimum_coverage", 0.9)]))
    assert json.loads(files["assessment.json"]) == {"passed": False, "violations": ["r"]} and "result.json" not in files


def test_command_line(spark, tmp_path, capsys):
    f, s = tmp_path / "f.json", tmp_path / "s.json"
    f.write_text(json.dumps(fixture()))
    s.write_text(json.dumps({"name": "s", "specifications": [{"name": "one", "rules": [{"id": "c", "type": "minimumCoverage", "minimumRatio": 0.9}]}]}))
    assert main(["suite", str(f), str(s)]) == 1 and not json.loads(capsys.readouterr().out)["passed"]
    assert main(["timeline", str(f)]) == 0 and "<svg" in capsys.readouterr().out
    assert main(["context", str(f)]) == 0
    w = tmp_path / "w.jsonl"
    w.write_text("\n".join(json.dumps(x) for x in fixture()["windows"]))
    out = tmp_path / "b"
    assert main(["audit-windows", str(w), "--target", "a", "--against", "b", "--window", "w", "--profile", "Redacted", "--out", str(out)]) == 0
    assert main(["verify-bundle", str(out)]) == 0 and not (out / "result.json").exists()


def test_portable_episode_documents(spark):
    from tidemark.support.fixtures import FixtureBuilder

    b = FixtureBuilder()
    for key, part, source, s, e in (("é", None, "a", 0, 4), ("z", "null", "a", 0, 4), ("z", None, "a", 5, 9), ("z", None, "a", 20, 22), ("z", None, "b", 6, 7), ("z", None, "b", 8, 12), ("k", None, "b", 0, 1)):
        b.closed("w", key, s, e, source=source, partition=part)
    w = b.open("w", "é", 2, source="b").build(spark)
    doc = {"name": "n", "windowName": "w", "target": {"source": "a"}, "against": {"source": "b"}, "stitchTolerance": 0, "relationTolerance": 0, "liveHorizon": 30}
    got = json.loads("".join(documents.episodes_json(spark, doc, w)))
    assert [(e["side"], e["index"], e["key"], e["partition_id"], e["start_m"]) for e in got["episodes"]] == [
        ("Target", 0, "z", None, 5), ("Target", 1, "z", None, 20), ("Target", 2, "z", "null", 0), ("Target", 3, "é", None, 0),
        ("Against", 0, "k", None, 0), ("Against", 1, "z", None, 6), ("Against", 2, "z", None, 8), ("Against", 3, "é", None, 2)]
    assert [(r["kind"], r["target"], r["against"], r["finality"]) for r in got["relations"]] == [
        ("Split", [0], [1, 2], "Final"), ("UnmatchedTarget", [1], [], "Final"), ("UnmatchedTarget", [2], [], "Final"), ("OneToOne", [3], [3], "Provisional"), ("UnmatchedAgainst", [], [0], "Final")]
    text = "".join(documents.episodes_markdown(spark, doc, w))
    assert '| Target | 2 | "z" | "null" | 0 | 4 | 1 | 4 | Final |' in text and '| Target | 0 | "z" | null |' in text and "| Split | 0 | 1, 2 | Final |" in text
    assert json.loads("".join(documents.episodes_json(spark, doc, w.limit(0)))) == {"format": documents.EPISODES, "version": 1, "name": "n", "episodes": [], "relations": []}
    for bad in ({"version": 2}, {"liveHorizon": -1}, {"against": {"source": "a"}}):
        with pytest.raises(ValueError):
            list(documents.episodes_json(spark, doc | bad, w))
