from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultloom.functions.numbering import number_globally, number_within
from faultloom.operators import audits, conversations, evaluation, frontend, quality, rollups, traces
from faultloom.params import checked_limit
from faultloom.plans import incremental
from faultloom.sources import readers, writers
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def test_flexible_profile(spark):
    df = spark.createDataFrame([("a", None, "20x9"), ("b", "KA1", "2019")], "unique_id string, vehicle_no string, mfg_year string")
    out = readers.resolve_vehicle_profile(df)
    assert rows(out, "uniqueid", "vehicle_number", "manufacturing_year", "customer_name", "tank_capacity") == [
        ("a", "", 0, "", 0.0), ("b", "KA1", 2019, "", 0.0)]
    with pytest.raises(ValueError):
        readers.resolve_vehicle_profile(spark.createDataFrame([("a",)], "id string"))


def test_latest_by_key_and_master(spark):
    df = spark.createDataFrame(
        [("t", "v", "obd_solution", "old", 1), ("t", "v", "obd_solution", "new", 2), ("t", "w", "gps_only", "x", 1)],
        "clientLoginId string, uniqueid string, solutionType string, model string, updated_at int")
    assert rows(readers.build_vehicle_master(df), "uniqueid", "model") == [("v", "new")]


def test_eval_question_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(
            "[" + ",\n".join(f'{{"id": "{name}{i}", "question": "q", "expected_tools": ["t"]}}' for i in range(3)) + "]")
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    assert readers.read_eval_questions(spark, paths).count() == 6
    assert rows(readers.read_eval_questions(spark, paths, 2), "id", "dataset") == [
        ("a0", "a.json"), ("a1", "a.json"), ("b0", "b.json"), ("b1", "b.json")]


def test_filter_questions(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    report = spark.createDataFrame([("a", ["x"]), ("b", []), (" c ", None)], "id string, failure_reasons array<string>")
    failed = readers.failed_ids(report)
    assert rows(readers.filter_questions(q), "id") == [("a",), ("b",), ("c",)]
    assert rows(readers.filter_questions(q, ["b "]), "id") == [("b",)]
    assert rows(readers.filter_questions(q, ["b"], failed), "id") == [("a",), ("b",)]
    # nothing failed and nothing named: no filter
    assert readers.filter_questions(q, [], failed.filter("false")).count() == 3


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("SELECT 'T' clientLoginId, DATE '2024-01-05' date, 1 n UNION ALL SELECT 'T', DATE '2024-02-05', 2")
    layout = writers.layouts()["fleet_fault_trends"]
    writers.rebuild(df, path, layout)
    writers.rebuild(df.filter("n = 2").withColumn("n", F.lit(9)), path, layout, only_touched_partitions=True)
    assert rows(spark.read.parquet(path), "n", "event_month") == [(1, 202401), (9, 202402)]
    writers.append(df.filter("n = 1"), path, layout)
    assert spark.read.parquet(path).count() == 3
    assert writers.exists(spark, path) and not writers.exists(spark, str(tmp_path / "none"))


def test_cooccurrence_has_no_limit(spark):
    """Vehicles with any number of codes count exactly."""
    few = [("t", f"V{i}", c, 1, 10 + i) for i in range(3) for c in ("A", "B", "C")]
    many = [("t", "BIG", f"C{i:03d}", 1, 5) for i in range(230)] + [("t", "BIG2", f"C{i:03d}", 2, 6) for i in range(230)]
    df = spark.createDataFrame(few + many, "clientLoginId string, uniqueid string, dtc_code string, episodes long, last_ts long")
    whole = rollups.dtc_cooccurrence(df)
    assert rows(whole.filter("dtc_code_a IN ('A', 'B')"), "dtc_code_a", "dtc_code_b", "cooccurrence_count", "vehicles_affected", "last_seen_ts") == [
        ("A", "B", 9, 3, 12), ("A", "C", 9, 3, 12), ("B", "C", 9, 3, 12)]
    assert whole.count() == 3 + 230 * 229 // 2
    assert whole.filter("dtc_code_a = 'C001' AND dtc_code_b = 'C229'").first()["cooccurrence_count"] == 230 + 460


def test_numbering(spark):
    df = spark.range(1000).selectExpr("id", "concat('k', id % 3) AS k", "id * 37 % 1000 AS o")
    out = number_within(df, ["k"], F.floor(F.col("o") / 100), ["o"])
    for k in ("k0", "k1", "k2"):
        got = [r["rn"] for r in out.filter(F.col("k") == k).orderBy("o").collect()]
        assert got == list(range(1, len(got) + 1))
    names = spark.range(500).selectExpr("concat('n', lpad(id * 7 % 500, 4, '0')) AS n")
    assert [r["rn"] for r in number_globally(names, "n").orderBy("n").collect()] == list(range(1, 501))


def _reference_mask(text, customers, vehicles):
    import re

    for names in (customers, vehicles):
        for name, alias in sorted(names, key=lambda p: (-len(p[0]), p[0])):
            text = re.sub(re.escape(name), alias, text, flags=re.IGNORECASE)
    return text


def test_mask_text(spark, monkeypatch):
    monkeypatch.setattr(frontend, "WINDOW", 16)
    customers = [("acme", "c1"), ("acme north", "c2"), ("x.y(z)", "c3"), ("b\\e", "c4")]
    vehicles = [("ka-1", "vehicle1"), ("ka-12", "vehicle2")]
    texts = ["Acme North owns KA-12 and ka-1; ACME too", "x.y(z) vs xay(z), B\\E", "nothing", "",
             "long " * 30 + "aCmE nOrTh " + "tail " * 30 + "KA-12"]
    as_map = lambda m: spark.createDataFrame([(n, n, a) for n, a in m], "identity string, original string, alias string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = {r["id"]: r["masked"] for r in frontend.mask_text(df, "t", as_map(customers), as_map(vehicles)).collect()}
    assert got.pop(99) is None
    assert got == {i: _reference_mask(t, customers, vehicles) for i, t in enumerate(texts)}


def test_pseudonymise(spark):
    df = spark.createDataFrame([(" Beta ",), ("alpha",), ("BETA",), ("",), (None,)], "c string")
    assert sorted(r[0] for r in frontend.pseudonymise(df, "c", "c").collect()) == ["", "", "c1", "c2", "c2"]


def test_search_needs_three_letters(spark):
    from testbed.inputs import warehouse
    from tests.conftest import SF

    w = warehouse(spark, SF)
    assert frontend.search_vehicles(w, "MACHINERY", "cu").count() == 0
    assert frontend.search_vehicles(w, "MACHINERY", " CUSTOMER ").count() > 0


def test_validation(spark):
    one = spark.sql("SELECT 'e' episode_id, 'T' clientLoginId, 'v' uniqueid, 'c' dtc_code, DATE '2024-01-01' date")
    tables = {n: one for n in quality.CHECKED}
    assert quality.validate_outputs(tables)["vehicle_fault_master"] == 1
    with pytest.raises(ValueError, match="empty"):
        quality.validate_outputs({**tables, "vehicle_fault_master": one.filter("false")})
    with pytest.raises(ValueError, match="duplicate"):
        quality.validate_outputs({**tables, "vehicle_fault_master": one.union(one)})
    two = spark.sql("SELECT 'v' uniqueid, 'A' clientLoginId UNION ALL SELECT 'v', 'B'")
    with pytest.raises(ValueError, match="tenant"):
        quality.validate_outputs(tables, two)


def test_conversation_rules(spark):
    ts = lambda h: datetime(2024, 1, 1, h)
    old = spark.createDataFrame([("a", 4)], "conversation_id string, message_index int")
    batch = spark.createDataFrame(
        [("a", "user", ts(2), 1), ("a", "assistant", ts(1), 0), ("b", "user", ts(1), 0), ("", "user", ts(1), 0), ("b", " ", ts(1), 1)],
        "conversation_id string, role string, ts timestamp, seq int")
    assert rows(conversations.assign_indexes(old, batch), "conversation_id", "seq", "message_index") == [
        ("a", 0, 5), ("a", 1, 6), ("b", 0, 0)]
    stored = spark.createDataFrame([("a", " ACME ", ts(1))], "conversation_id string, customer_name string, created_ts timestamp")
    asked = spark.createDataFrame([("a", "acme"), ("a", "other"), ("a", ""), ("z", "other")], "conversation_id string, customer_name string")
    assert rows(conversations.scope_violations(asked, stored), "customer_name") == [("other",)]


def test_audits(spark):
    q = lambda *texts: spark.createDataFrame([(t,) for t in texts], "query string")
    assert [r[0] for r in audits.audit_readonly(q(
        "select 1", "((WITH a as (select 1) select * from a", "update t", "select 1; DROP table x", "select created from t")).select(
        "readonly_finding").collect()] == [None, None, "not_a_select", "forbidden_keyword", None]
    assert [r[0] for r in audits.audit_tables(q('select 1 from `db.Secret` join "dtc_master" d', "select 2")).select(
        "disallowed_tables").collect()] == [["secret"], []]
    shape = audits.audit_shape(q(
        "select code, count(*) from t", "select count(*) from t", "select a, sum(b) from t group by a",
        "select x from vehicle_fault_master", "select * from t limit 3"))
    assert [tuple(r) for r in shape.select("raw_fact_scan", "select_star", "ungrouped_columns").collect()] == [
        (0, 0, 1), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0)]
    ctx = spark.createDataFrame(
        [("select 1 where customer_name = 'o''hara' and v = 'k1'", "O'Hara", "K1", "", ""),
         ("select 1 where customer_name = 'x'", "y", "", "", ""), ("select 1", "y", "", "", ""),
         ("select 'u1'", "", "K1", "U1", ""), ("select 1", "", "", "", "P1")],
        "query string, customer_name string, vehicle_number string, uniqueid string, dtc_code string")
    assert [r[0] for r in audits.audit_scope(ctx).select("scope_finding").collect()] == [
        None, "customer_mismatch", "customer_filter_missing", None, "dtc_scope_missing"]


def test_relevant_tables_default(spark):
    from faultloom.functions.catalogue import CATALOGUE

    only = [e for e in CATALOGUE if e.table in ("vehicle_fault_master", "dtc_master")]
    out = audits.relevant_tables(spark.createDataFrame([("zzz",)], "question string"), 4, only)
    assert rows(out, "table_name", "score") == [("vehicle_fault_master", 0)]


def test_evaluation_rules(spark):
    q = spark.createDataFrame(
        [("1", "d", "q", "a", ["x", "y"], ["Foo", "bar"]), ("2", "d", "q", "a", [], []), ("3", "d", "q", "a", ["x"], [])],
        "id string, dataset string, question string, expected_intent string, expected_tools array<string>, expected_output_contains array<string>")
    r = spark.createDataFrame(
        [("1", "has FOO", "a", ["x", "z"], [("x", "SELECT 1", True), ("", "drop", False)], [("node", "n", 1.5), ("sql", "n", 9.0), ("node", "m", 0.5)],
          (10, 5), ["context_length_exceeded: 9"], 2.0, None), ("2", "", "b", [], [], [], None, [], 1.0, (0.9, 0.8, 0.7, 0.25))],
        "id string, text string, intent string, tools_called array<string>, sql_events array<struct<tool:string,query:string,success:boolean>>, "
        "trace_log array<struct<type:string,node:string,duration:double>>, token_usage struct<prompt:long,completion:long>, failure_reasons array<string>, "
        "latency_sec double, judge struct<correctness:double,relevance:double,completeness:double,hallucination_risk:double>")
    scored = evaluation.score_questions(q, r)
    one, two, three = (scored.filter(F.col("id") == i).first() for i in "123")
    assert (one["tool_recall"], one["tool_precision"], one["tool_f1"], one["keyword_hits"]) == (0.5, 0.5, 0.5, 0.5)
    assert (one["relevance"], one["completeness"], one["hallucination_risk"]) == (0.8, 0.5, 0.5)
    assert (one["sql_success_rate"], one["sql_tool_alignment"], one["sql_shape_validity"], one["sql_relevance_score"]) == (0.5, 0.5, 0.5, 0.5)
    assert one["node_latency_by_node"] == {"m": 0.5, "n": 1.5} and one["node_latency_max_sec"] == 1.5
    assert (two["tool_f1"], two["sql_success_rate"], two["judge_mode"], two["groundedness_score"]) == (1.0, 1.0, "llm", 0.75)
    assert (three["tool_recall"], three["tool_precision"], three["sql_success_rate"], three["intent_match"]) == (0.0, 1.0, 0.0, 0)
    total = evaluation.eval_summary(scored).first()
    assert len(evaluation.metric_profile(evaluation.eval_summary(scored)).columns) == 8
    assert total["questions_evaluated"] == 3 and total["llm_judge_ratio"] == 0.3333
    assert total["context_length_error_rate"] == 0.3333 and total["failed_questions_count"] == 1


def test_run_deltas(spark):
    c = "token_prompt:long,token_completion:long,tools_used:long,failures:long,sql_events:long,sql_errors:long"
    df = spark.createDataFrame([("r", 0, "n", (1, 1, 0, 0, 0, 0), (5, 2, 1, 0, 3, 1))], f"request_id string, pos int, node string, pre struct<{c}>, post struct<{c}>")
    assert tuple(traces.run_deltas(df).first())[3:] == (4, 1, 1, 0, 3, 1)


def test_sync_cutoff(spark):
    now = datetime(2024, 2, 1)
    assert incremental.sync_cutoff(None, "k", now) == datetime(2024, 1, 18)
    state = spark.createDataFrame(
        [("k", datetime(2024, 1, 30), 1), ("k", datetime(2024, 1, 31), 2)], "pipeline_key string, last_synced_at timestamp, updated_at int")
    assert incremental.sync_cutoff(state, "k", now) == datetime(2024, 1, 30, 23, 55)
    run = "id string, start_time timestamp, extra struct<metadata:struct<request_id:string>>"
    runs = spark.createDataFrame(
        [("r1", datetime(2024, 1, 31), (("",),)), ("r2", datetime(2024, 1, 30), (("known",),)), ("r3", None, ((None,),)),
         ("r4", datetime(2024, 1, 1), (("old",),)), ("", datetime(2024, 1, 31), (("x",),))], run)
    known = spark.createDataFrame([("known",)], "request_id string")
    new, report, after = incremental.sync_runs(runs, known, None, "k", now)
    assert rows(new, "id") == [("r1",), ("r3",)]
    assert report.first().asDict() == {
        "fetched": 5, "eligible": 3, "skipped_empty": 0, "skipped_existing": 1, "inserted": 2, "failed": 0, "watermark": datetime(2024, 1, 31)}
    assert tuple(after.first()) == ("k", datetime(2024, 1, 31), now, "inserted=2, skipped_existing=1, failed=0")
    assert incremental.cdc_window(None, "p", 100 * 86400).since_ts == 10 * 86400


def test_limits_out_of_range_are_errors():
    assert [checked_limit(v, 10, 1, 200) for v in ("x", None, "7")] == [10, 10, 7]
    for v in (0, 999):
        with pytest.raises(ValueError):
            checked_limit(v, 10, 1, 200)


def test_numbering_with_nulls(spark):
    df = spark.createDataFrame([("a", None, 3), ("a", None, 1), ("a", 5, 9), (None, None, 2), (None, 1, 4)], "k string, chunk int, o int")
    got = number_within(df, ["k"], F.col("chunk"), ["o"])
    assert sorted((tuple(r) for r in got.select("k", "o", "rn").collect()), key=str) == sorted(
        [("a", 1, 1), ("a", 3, 2), ("a", 9, 3), (None, 2, 1), (None, 4, 2)], key=str)


def test_messages_without_a_time_are_kept(spark):
    from faultloom.operators import conversations

    stored = spark.createDataFrame([("c", 4)], "conversation_id string, message_index int")
    batch = spark.createDataFrame([("c", "user", None, 2), ("c", "user", T0, 1), ("d", "user", None, 1)], "conversation_id string, role string, ts timestamp, seq int")
    got = conversations.assign_indexes(stored, batch)
    assert rows(got, "conversation_id", "seq", "message_index") == [("c", 1, 6), ("c", 2, 5), ("d", 1, 0)]


def _runs(spark, starts):
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("start_time", T.TimestampType()),
        T.StructField("outputs", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("extra", T.StructType([T.StructField("metadata", T.StructType([T.StructField("request_id", T.StringType())]))]))])
    return spark.createDataFrame([(i, t, ("x",) if i != "E" else None, ((None,),)) for i, t in starts], schema)


def test_sync_stores_every_run_in_small_batches(spark, tmp_path):
    from faultloom.plans import incremental

    runs = _runs(spark, [(f"R{i}", T0 + timedelta(minutes=i)) for i in range(5)] + [("E", T0), ("N", None)])
    state, existing, seen = None, spark.createDataFrame([("R1",)], "request_id string"), []
    for n in range(4):
        path = str(tmp_path / f"s{n}")
        new, report, fresh = incremental.sync_runs(
            runs, existing, state, "p", T0 + timedelta(days=1), batch=2, safety_minutes=0, store=lambda df, p=path: df.select("id").write.parquet(p))
        fresh.write.parquet(path + "-state")
        state = spark.read.parquet(path + "-state")
        ids = [r.id for r in spark.read.parquet(path).collect()]
        seen += ids
        existing = existing.union(spark.createDataFrame([(i,) for i in ids], "request_id string"))
    assert sorted(seen) == ["N", "R0", "R2", "R3", "R4"]
    assert report.first().asDict()["skipped_empty"] == 0


def test_failed_sync_moves_nothing(spark):
    from faultloom.plans import incremental

    def broken(df):
        raise OSError

    runs = _runs(spark, [("R0", T0), ("E", T0)])
    _, report, fresh = incremental.sync_runs(runs, spark.createDataFrame([], "request_id string"), None, "p", T0, store=broken)
    got = report.first()
    assert (got.fetched, got.eligible, got.skipped_empty, got.inserted, got.failed) == (2, 2, 1, 0, 1) and fresh.count() == 0


def test_every_prompt_finds_its_cause(spark):
    from faultloom.operators import observability

    scores = spark.createDataFrame(
        [(f"p{i}", "v1", f"cause{i}", 0.1, 0.2) for i in range(150) for _ in range(3)],
        "prompt_key string, prompt_version string, root_cause string, node_score double, final_score double")
    queue = observability.prompt_refinement_queue(observability.prompt_cohorts(scores), observability.prompt_failure_buckets(scores))
    assert queue.count() == 150 and queue.filter("dominant_root_cause = 'unknown'").count() == 0


@pytest.mark.parametrize("size", [100_000])
def test_mask_long_text(spark, size):
    """One long text and names of many lengths: found in time linear in the text."""
    words = [f"n{'x' * (i % 40)}{i}" for i in range(60)]
    text = " ".join(words[i % 60] if i % 9 == 0 else f"w{i}" for i in range(size // 6))
    names = spark.createDataFrame([(w, f"alias{i}_") for i, w in enumerate(words)], "identity string, alias string")
    df = spark.createDataFrame([(1, text), (2, "no names"), (3, None)], "i int, t string")
    got = {r.i: r.masked for r in frontend.mask_text(df, "t", names, names.limit(0)).collect()}
    assert got == {1: _reference_mask(text, [(w, f"alias{i}_") for i, w in enumerate(words)], []), 2: "no names", 3: None}


def test_trace_store(spark, tmp_path):
    """Requests are stored once; a repeated batch changes nothing; a new column is taken in."""
    from faultloom.plans.trace_store import TABLES, TraceStore
    from testbed import traces as tb
    from tests.conftest import SF

    flat = tb.payloads(spark, SF)
    store = TraceStore(spark, str(tmp_path / "traces"))
    store.append(flat.filter("latency_sec < 2"), "b1")
    before = {n: store.table(n).count() for n in TABLES}
    store.append(flat.filter("latency_sec < 2"), "b1")
    assert {n: store.table(n).count() for n in TABLES} == before
    store.append(flat.drop("latency_sec").withColumn("region", F.lit("eu")), "b2")
    assert store.table("trace_requests").count() == flat.count() == store.table("trace_requests").select("request_id").distinct().count()
    assert store.table("prompt_inventory").groupBy("prompt_key", "prompt_version").count().filter("count > 1").count() == 0
    seen = store.payloads().groupBy("batch").agg(F.count("latency_sec").alias("old"), F.count("region").alias("new")).orderBy("batch").collect()
    assert (seen[0].new, seen[1].old) == (0, 0) and seen[0].old > 0 and seen[1].new > 0


def test_trace_store_keeps_a_request_once(spark, tmp_path, monkeypatch):
    """Requests twice in a batch, a batch that failed half-way and comes again under another name, many small appends."""
    from faultloom.plans import trace_store
    from testbed import traces as tb
    from tests.conftest import SF

    flat = tb.payloads(spark, SF).limit(40).persist()
    total = flat.count()
    store = trace_store.TraceStore(spark, str(tmp_path / "a"), fan=3)
    one = flat.orderBy("request_id").limit(1)
    newer = one.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("query", F.lit("newer"))

    def fails(*_args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(trace_store.TraceStore, "_commit", fails)
        with pytest.raises(OSError):
            store.append(flat, "lost")
    assert not store.has("trace_requests")
    with pytest.raises(ValueError):
        store.table("trace_requests")
    store.append(one.union(newer).union(one), "first")
    assert [r["query"] for r in store.payloads().collect()] == ["newer"]
    assert store.table("trace_requests").count() == 1
    for i in range(2):
        store.append(flat.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == i).union(one), f"b{i}")
    requests = store.table("trace_requests")
    assert requests.count() == total == requests.select("request_id").distinct().count()
    assert {r[0] for r in requests.select("batch").distinct().collect()} == {"first", "b0", "b1"}
    # three appends are one merged part
    assert store._state().live[0][1] == len(store._state().live) == 1
    assert len(requests.inputFiles()) <= 4
    whole = trace_store.TraceStore(spark, str(tmp_path / "b"))
    whole.append(flat.filter("request_id <> '{}'".format(one.first()["request_id"])).union(newer), "all")
    for name in trace_store.TABLES:
        assert store.table(name).count() == whole.table(name).count(), name
        assert store.table(name).columns == whole.table(name).columns, name


def test_readers_of_the_trace_store_see_one_commit(spark, tmp_path):
    """A reader that began before a merge goes on with what it has; one that comes after sees each request once."""
    from faultloom.plans.trace_store import TraceStore
    from testbed import traces as tb
    from tests.conftest import SF

    flat = tb.payloads(spark, SF).limit(30).persist()
    store = TraceStore(spark, str(tmp_path / "t"), fan=100)
    for i in range(2):
        store.append(flat.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == i), f"b{i}")
    before = store.table("trace_nodes")
    n = before.count()
    store.fan = 2
    assert store.compact() == 1 and len(store._state().live) == 1
    assert before.count() == n == store.table("trace_nodes").count()
    assert len(store.table("trace_requests").inputFiles()) <= 4
    day = store.table("trace_requests").filter("event_date = DATE '2024-01-01'")
    assert "PushedFilters: [IsNotNull(event_date), EqualTo(event_date,2024-01-01)]" in day._jdf.queryExecution().toString()
    assert store.compact() == 0


def test_incremental_run_leaves_other_months_alone(spark, tmp_path):
    import os

    from faultloom.operators.fault_master import FAULT_COLUMNS, vehicle_fault_master
    from faultloom.operators.events import events_exploded
    from faultloom.params import Params
    from faultloom import schemas

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    vm = spark.createDataFrame([("T", v, v, "C", "m", 2000, "t", "obd_solution", 0.0) for v in ("V1", "V2")],
                               "clientLoginId string, uniqueid string, vehicle_number string, customer_name string, model string, manufacturing_year int, vehicle_type string, solutionType string, tank_capacity double")
    codes = readers.build_dtc_master(spark.createDataFrame([("P1", 3)], "dtc_code string, severity_level int"))
    # V1 was last seen in January and is resolved; V2 goes on in March
    message = lambda v, n: (v, day(n), ["P1"], 0.0, 0.0, None)
    first = [message("V1", 5), message("V1", 6), message("V2", 40)]
    cycles = spark.createDataFrame([("V1", int(day(7).timestamp())), ("V1", int(day(30).timestamp())), ("V2", int(day(41).timestamp())), ("V2", int(day(60).timestamp()))], "uniqueid string, cycle_ts long")
    of = lambda rows_: spark.createDataFrame(rows_, schemas.DTC_HISTORY)
    p = lambda n: Params(as_of=int(day(n).timestamp()))
    folder = str(tmp_path / "w")
    incremental.run_incremental(spark, folder, of(first), cycles, vm, codes, p(61))
    january = str(tmp_path / "w" / "vehicle_fault_master" / "event_month=202401")
    before = sorted((f, os.stat(f"{january}/{f}").st_mtime_ns) for f in os.listdir(january))
    every = [*first, message("V2", 62)]
    got = incremental.run_incremental(spark, folder, of(every), cycles, vm, codes, p(63))
    assert sorted((f, os.stat(f"{january}/{f}").st_mtime_ns) for f in os.listdir(january)) == before
    want = vehicle_fault_master(events_exploded(of(every), vm, p(63)), cycles, vm, codes, p(63))
    assert rows(got, *FAULT_COLUMNS) == rows(want, *FAULT_COLUMNS)
    assert spark.read.parquet(f"{folder}/cdc_checkpoint").count() == 2


def test_incremental_run_takes_changed_masters(spark, tmp_path):
    """A renamed customer, a changed severity, a vehicle that comes and one that goes: equal to a full build, other months untouched."""
    import os

    from faultloom import schemas
    from faultloom.operators.events import events_exploded
    from faultloom.operators.fault_master import FAULT_COLUMNS, vehicle_fault_master
    from faultloom.params import Params

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    sec = lambda n: int(day(n).timestamp())
    master = lambda **names: spark.createDataFrame(
        [("T", v, v, c, "m", 2000, "t", "obd_solution", 0.0) for v, c in names.items()],
        "clientLoginId string, uniqueid string, vehicle_number string, customer_name string, model string, manufacturing_year int, vehicle_type string, solutionType string, tank_capacity double")
    codes = lambda severity: readers.build_dtc_master(spark.createDataFrame([("P1", 3), ("P2", severity)], "dtc_code string, severity_level int"))
    # quiet vehicles: Q in January (resolved), R renamed in February, S has the changed code in March, O is open since January
    said = [("Q", 5, "P1"), ("R", 40, "P1"), ("S", 62, "P2"), ("N", 41, "P1"), ("G", 42, "P1"), ("O", 6, "P1")]
    history = spark.createDataFrame([(v, day(n), [c], 0.0, 0.0, None) for v, n, c in said], schemas.DTC_HISTORY)
    cycles = spark.createDataFrame([(v, sec(n)) for v, n in (("Q", 9), ("R", 44), ("S", 65))], "uniqueid string, cycle_ts long")
    p = lambda n: Params(as_of=sec(n))
    folder = str(tmp_path / "w")
    incremental.run_incremental(spark, folder, history, cycles, master(Q="C", R="C", S="C", G="C", O="C"), codes(1), p(70))
    files = lambda m: sorted((f, os.stat(f"{folder}/vehicle_fault_master/event_month={m}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/vehicle_fault_master/event_month={m}"))
    january = files(202401)
    vm, dm = master(Q="C", R="renamed", S="C", N="C", O="C"), codes(4)
    got = incremental.run_incremental(spark, folder, history, cycles, vm, dm, p(71))
    want = vehicle_fault_master(events_exploded(history, vm, p(71)), cycles, vm, dm, p(71))
    assert rows(got, *FAULT_COLUMNS) == rows(want, *FAULT_COLUMNS)
    assert {r.uniqueid for r in got.collect()} == {"Q", "R", "S", "N", "O"}
    # neither the resolved nor the long open vehicle of January was recomputed
    assert files(202401) == january
    # and once nothing changes, nothing is
    before = {m: files(m) for m in (202401, 202402, 202403)}
    incremental.run_incremental(spark, folder, history, cycles, vm, dm, p(72))
    assert {m: files(m) for m in before} == before
