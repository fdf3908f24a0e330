"""Documents, imports, streaming recorder and the command line."""

import json

import pytest

from tidemark.__main__ import main
from tidemark.operators import record
from tidemark.sources import documents, readers
from tidemark.streaming import live


def fixture(**plan):
    w = lambda s, a, b: {"windowName": "w", "key": "k", "source": s, "startPosition": a, "endPosition": b}
    return {"windows": [w("a", 1, 5), w("b", 3, 7)], "plan": {"name": "p", "targetSource": "a", "againstSources": ["b"], "scopeWindow": "w", "comparators": ["overlap", "residual", "coverage"], "strict": False} | plan}


def test_fixture(spark):
    got = documents.run_fixture(spark, fixture())
    assert got["valid"] and {n: d.count() for n, d in got["rows"].items()} == {"overlap": 1, "residual": 1, "coverage": 2}
    got = documents.run_fixture(spark, fixture(scopeWindow=None, strict=True))
    assert not got["valid"] and got["diagnostics"] == ["BroadSelector"] and not got["rows"]
    doc = fixture()
    doc["windows"][0]["endPosition"] = None
    assert "OpenWindowsWithoutPolicy" in documents.run_fixture(spark, doc)["diagnostics"]


def test_segment_and_tag_scope(spark):
    doc = fixture(scopeSegments=[{"name": "stage", "value": "Escalated"}], scopeTags=[{"name": "fleet", "value": "critical"}])
    doc["windows"][0] |= {"segments": [{"name": "stage", "value": "Escalated"}], "tags": [{"name": "fleet", "value": "critical"}]}
    assert [(r.start_m, r.end_m) for r in documents.run_fixture(spark, doc)["rows"]["residual"].collect()] == [(1, 5)]


@pytest.mark.parametrize("kind", ["jsonl", "csv"])
def test_import_round_trip(spark, tmp_path, kind):
    ev = [("a", "d", "on", "eu", 1), ("b", "d", "on", "eu", 2), ("a", "d", "off", "eu", 5), ("b", "d", "off", "eu", 6)]
    p = tmp_path / "e"
    cols = ("source", "deviceId", "status", "region", "position")
    p.write_text("\n".join(json.dumps(dict(zip(cols, e))) for e in ev) if kind == "jsonl" else "\n".join(",".join(map(str, e)) for e in (cols, *ev)))
    m = {"input": kind, "source": "source", "position": "position", "key": "deviceId", "windows": [{"name": "On", "active": {"field": "status", "equals": "on"}, "segments": [{"name": "region", "field": "region"}]}]}
    (tmp_path / "m").write_text(json.dumps(m))
    assert main(["import-events", str(p), str(tmp_path / "m"), str(tmp_path / "out")]) == 0
    w = readers.read_windows(spark, str(tmp_path / "out"))
    assert sorted((r.source, r.start_position, r.end_position, r.segments[0].value) for r in w.collect()) == [("a", 1, 5, "eu"), ("b", 2, 6, "eu")]


def test_bundle_and_command_line(spark, tmp_path, capsys):
    f = tmp_path / "f.json"
    f.write_text(json.dumps(fixture()))
    assert main(["compare", str(f)]) == 0 and json.loads(capsys.readouterr().out)["rows"]["overlap"][0]["start_m"] == 3
    w = tmp_path / "w.jsonl"
    w.write_text("\n".join(json.dumps(x) for x in fixture()["windows"]))
    out = tmp_path / "bundle"
    assert main(["audit-windows", str(w), "--target", "a", "--against", "b", "--window", "w", "--out", str(out)]) == 0
    assert main(["verify-bundle", str(out)]) == 0
    (out / "result.md").write_text("changed")
    assert main(["verify-bundle", str(out)]) == 1
    with pytest.raises(SystemExit) as e:
        main(["nonsense"])
    assert e.value.code == 2


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(n + 1, f"k{n % 3}", "a", "p", (n * 7) % 5 < 2) for n in range(60)]
    df = spark.createDataFrame(rows, "pos long, key string, source string, partition_id string, active boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.record_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.kind, r.position) for r in spark.table("seen").collect()}
    state = {}
    want = set()
    for pos, key, _, _, on in rows:
        if on != state.get(key, False):
            want.add((key, "Opened" if on else "Closed", pos))
        state[key] = on
    assert got == want
    assert record.any_active is not None


def test_streamed_segments_and_confirmations(spark, tmp_path):
    steps = [(1, True, "a"), (2, True, "a"), (3, True, "b"), (4, False, "b"), (5, True, "b"), (6, False, "b"), (7, False, "b"), (8, True, "c"), (9, False, "c"), (10, True, "c"), (11, True, "c"), (12, False, "c"), (13, True, "d")]
    rows = [(n, "k", "s", None, on, [(("phase"), c)]) for n, on, c in steps]
    df = spark.createDataFrame(rows, "pos long, key string, source string, partition_id string, active boolean, segments array<struct<name:string,value:string>>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.record_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 2).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.position, r.kind, r.start_position, json.loads(r.segments)[0]["value"]) for r in spark.table("steps").collect())
    assert got == [(2, "Opened", 2, "a"), (3, "Closed", 2, "a"), (3, "Opened", 3, "b"), (7, "Closed", 3, "b"), (11, "Opened", 11, "c"), (13, "Closed", 11, "c"), (13, "Opened", 13, "d")]
