"""Run records from JSON lines: drift, unknown fields, damage."""

from __future__ import annotations

import json
from datetime import datetime

from faultloom.sources import run_lines
from faultloom.sources.readers import read_trace_runs
from pyspark.sql import functions as F

GOOD = {
    "id": "r1", "start_time": "2024-01-02T03:04:05Z", "inputs": {"query": "q"},
    "outputs": {"text": "t", "evaluation": {"final_score": 0.5, "root_cause": "x"}, "nodes_executed": ["a", "b"],
                "trace_log": [{"node": "n", "duration": 1.5, "sql_events": [{"row_count": 3}]}],
                "version": {"prompt_versions": {"p": "v1"}}},
    "extra": {"metadata": {"request_id": "q1"}}}


def stored(spark, tmp_path, lines):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "runs.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    path = f"{tmp_path}/stored"
    run_lines.append_run_lines(spark, f"{tmp_path}/in", path)
    return path


def test_a_record_is_read_in_full(spark, tmp_path):
    path = stored(spark, tmp_path, [GOOD])
    row = run_lines.stored_runs(spark, path).first()
    assert (row.id, row.start_time, row.drift, row.unknown) == ("r1", datetime(2024, 1, 2, 3, 4, 5), [], [])
    assert row.outputs.trace_log[0].sql_events[0].row_count == 3 and row.outputs.version.prompt_versions == {"p": "v1"}
    flat = read_trace_runs(run_lines.stored_runs(spark, path), ("raw",)).first()
    assert (flat.request_id, flat.query, flat.text, flat.nodes_executed) == ("q1", "q", "t", ["a", "b"])


def test_drift_costs_only_its_field(spark, tmp_path):
    text_score = json.loads(json.dumps(GOOD))
    text_score["outputs"]["evaluation"]["final_score"] = "0.25"       # a number as text is a number
    no_score = json.loads(json.dumps(GOOD))
    no_score["id"], no_score["outputs"]["evaluation"]["final_score"], no_score["inputs"] = "r2", "high", None
    flat_outputs = {"id": "r3", "outputs": "only text", "start_time": None}
    path = stored(spark, tmp_path, [text_score, no_score, flat_outputs])
    got = {r.id: r for r in run_lines.stored_runs(spark, path).collect()}
    assert got["r1"].outputs.evaluation.final_score == 0.25 and got["r1"].drift == []
    assert got["r2"].outputs.evaluation.final_score is None and got["r2"].outputs.evaluation.root_cause == "x"
    assert got["r2"].drift == ["outputs.evaluation.final_score"] and got["r2"].inputs is None
    assert got["r3"].outputs is None and got["r3"].id == "r3"


def test_unknown_fields_stay(spark, tmp_path):
    more = json.loads(json.dumps(GOOD))
    more["cost"], more["outputs"]["tags"], more["extra"]["metadata"]["région"] = 7, ["x", "y"], "eu"
    path = stored(spark, tmp_path, [more])
    row = run_lines.stored_runs(spark, path).select(
        "unknown", F.try_variant_get("raw", "$.cost", "int").alias("cost"), F.try_variant_get("raw", "$.outputs.tags[1]", "string").alias("tag")).first()
    assert sorted(row.unknown) == ["cost", "extra.metadata.région", "outputs.tags"] and (row.cost, row.tag) == (7, "y")


def test_damage_is_set_aside_and_counts_add_up(spark, tmp_path):
    cut = json.dumps(GOOD)[:-20]
    long = {**GOOD, "id": "long", "outputs": {"text": "é" * 300_000}}
    lines = [GOOD, "", "   ", cut, "[1, 2]", "null", '"x"', {"id": ""}, {"outputs": {}}, GOOD, long, '{"id": "a", "id": "b"}']
    path = stored(spark, tmp_path, lines)
    counts = {r.reason: r.lines for r in run_lines.line_counts(spark, path).collect()}
    assert counts == {"ok": 3, "not json": 2, "not an object": 3, "no id": 2}
    assert sum(counts.values()) == len(lines) - 2
    assert {r.line for r in run_lines.quarantined(spark, path).collect() if r.reason == "not json"} == {cut, '{"id": "a", "id": "b"}'}
    assert max(len(r.outputs.text) for r in run_lines.stored_runs(spark, path).collect()) == 300_000


def test_no_lines(spark):
    empty = run_lines.parse_run_lines(spark.createDataFrame([(None, "x")], "value string, raw string"))
    assert empty.isEmpty() and empty.columns == ["reason", "line", "raw", "run", "drift", "unknown"]
