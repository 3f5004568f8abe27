"""What keeps the findings of round 3 from coming back: sizes that must not grow with the input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from faultloom.operators import evaluation, frontend
from faultloom.operators.fault_master import FAULT_COLUMNS, fault_master_from_episodes, occurring, vehicle_fault_master
from faultloom.plans import incremental
from faultloom.session import measured
from faultloom.sources import readers, writers
from faultloom.streaming.engine_episodes import EpisodeCloser
from testbed.inputs import PARAMS, dtc_history, engine_cycles, warehouse
from tests.conftest import SF, rows


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_that_begin_alike_make_no_pairs(spark):
    """a place of a text is cut once for each length of a name that begins so, not once for each name."""
    names = spark.createDataFrame([(f"customer#0000000{i:03d}", f"v{i}", 1) for i in range(400)], "identity string, alias string, kind int")
    texts = spark.createDataFrame([(str(i), f"fault on customer#0000000{i:03d}") for i in range(50)], "id string, low string")
    found = frontend._found(texts, names)
    assert {r["id"]: [n["alias"] for n in r["found"]] for r in found.collect()} == {str(i): [f"v{i}"] for i in range(50)}
    # the texts meet whole names only: every join on a hash has one row a beginning
    joins = [line for line in _plan(found).splitlines() if "Join" in line]
    assert any("identity" in line for line in joins) and not any("contains" in line.lower() for line in joins)


def test_fault_rows_read_stored_episodes(spark):
    """no task sorts messages for both the risk and the fault rows."""
    w = warehouse(spark, SF)
    assert "Window" not in _plan(vehicle_fault_master(w.events, w.cycles, w.vm, w.dm, PARAMS))
    ids = w.vm.select("uniqueid").limit(20)
    again = incremental.rebuild_impacted(w.vfm, ids, dtc_history(spark, SF), w.cycles, w.vm, w.dm, PARAMS)
    assert "Window" not in _plan(again)
    assert rows(again, "episode_id", "last_ts") == rows(w.vfm, "episode_id", "last_ts")


def test_stored_codes_are_known_before_the_plan(spark):
    """F4, F7, F8: no row of an episode is dealt by code where the codes it can name are few."""
    w = warehouse(spark, SF)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    try:
        measured(spark)
        table = w.build("vehicle_fault_master")
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [dtc_code" in plan and "hashpartitioning(dtc_code" not in plan
        lazily = fault_master_from_episodes(w.table("fault_episodes"), w.vm, w.dm, PARAMS)
        assert rows(table, *FAULT_COLUMNS) == rows(lazily, *FAULT_COLUMNS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept) if kept else spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_episodes_read_stored_cycles(spark):
    """F4, F8: the raw cycles are read once, not by each use of them."""
    w = warehouse(spark, SF)
    assert "get_json_object" not in _plan(w.build("fault_episodes"))
    assert rows(w.cycles, "uniqueid", "cycle_ts") == rows(readers.engine_cycle_seconds(engine_cycles(spark, SF)), "uniqueid", "cycle_ts")


def test_a_run_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """later runs stage the recomputed rows as they come, and lay out each month once; master rows are digested once."""
    from faultloom import Params

    w, calls = warehouse(spark, SF), []
    for module, name in ((writers, "write_partitioned"), (writers, "rebuild"), (incremental, "master_digests")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: (calls.append((_n, str(a[1]))), _f(*a, **k))[1])
    history = dtc_history(spark, SF)
    for as_of in (PARAMS.as_of - 2 * 86400, PARAMS.as_of):
        calls.clear()
        p = Params(as_of=as_of, gap=PARAMS.gap, cutoff=PARAMS.cutoff, k=PARAMS.k)
        table = incremental.run_incremental(
            spark, str(tmp_path), history.filter(F.unix_timestamp("ts") <= as_of), w.cycles.filter(F.col("cycle_ts") <= as_of), w.vm, w.dm, p)
    assert rows(table, *FAULT_COLUMNS) == rows(w.vfm, *FAULT_COLUMNS)
    assert [n for n, _ in calls].count("master_digests") == 1
    assert [n for n, to in calls if n != "master_digests" and "cdc_" not in to] == ["rebuild"]


def test_only_named_codes_are_dealt(spark):
    codes = spark.range(1000).select(F.concat(F.lit("P"), "id").alias("dtc_code"), "id")
    named = spark.createDataFrame([("P1",), ("P1",), ("P7",), (None,), ("none",)], "dtc_code string")
    assert rows(occurring(codes, named), "dtc_code") == [("P1",), ("P7",)]


def test_broadcasts_go_by_measured_size(spark):
    """F3, F4, F5, F8: a packed file says little about the bytes that a broadcast sends through the driver."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        measured(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "1m"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_worker_tokenizes_in_one_thread(monkeypatch):
    """op10: threads of every worker process hold memory of their own."""
    import os

    import public_tokenizers
    from faultloom.llm.packing import WordTokenizer

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    WordTokenizer(str(public_tokenizers.path("word_bpe_49k.json")))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


class _Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "exists": lambda: self.value is not None, "get": lambda: self.value if self.value is not None else iter(()),
                "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "value", list(v)),
                "appendList": lambda v: setattr(self, "value", [*(self.value or []), *v]), "clear": lambda: setattr(self, "value", None),
                "containsKey": lambda k: k in self.map, "getValue": self.map.get, "updateValue": self.map.__setitem__,
                "removeKey": self.map.pop, "iterator": lambda: iter(list(self.map.items())),
            }[name](*args)
        return call


class _Handle:
    def __init__(self):
        self.stores = []

    def _new(self, *args):
        self.stores.append(_Store())
        return self.stores[-1]

    getMapState = getListState = getValueState = _new

    def registerTimer(self, at):
        self.at = at

    deleteTimer = registerTimer


class _Watermark:
    def getCurrentWatermarkInMs(self):
        return 10**9


def test_rows_of_a_vehicle_cost_few_state_calls(spark):
    """the store is called per vehicle, not per row; equal places add up over deliveries."""
    closer, handle = EpisodeCloser(100), _Handle()
    closer.init(handle)
    part = pd.DataFrame({"ts": range(1, 401), "kind": 1, "dtc_code": "P1", "n": 1})
    list(closer.handleInputRows(("V1",), iter([part, part]), None))
    list(closer.handleInputRows(("V1",), iter([part.head(1), part.tail(1).assign(dtc_code=None)]), None))
    out = pd.concat(closer.handleExpiredTimer(("V1",), _Watermark(), None))
    assert [tuple(r) for r in out.itertuples(index=False)] == [("V1", "P1", 1, 400, 801, 0)]
    assert sum(s.calls for s in handle.stores) < 40


def test_report_and_scores_carry_little(spark, tmp_path):
    """of the events only what is scored passes the join, and the rows of the report are packed."""
    event = "type string, node string, duration double, payload string"
    q = spark.createDataFrame([("a", "d", "why", "x", ["t"], ["k"])], "id string, dataset string, question string, expected_intent string, expected_tools array<string>, expected_output_contains array<string>")
    r = spark.createDataFrame(
        [("a", "k", "x", ["t"], [("t", "SELECT 1", True, "p" * 99)], [("node", "n", 1.5, "p" * 99)], (1, 2), [], 0.5)],
        f"id string, text string, intent string, tools_called array<string>, sql_events array<struct<tool: string, query: string, success: boolean, payload: string>>, "
        f"trace_log array<struct<{event.replace(' ', ': ')}>>, token_usage struct<prompt: int, completion: int>, failure_reasons array<string>, latency_sec double".replace(",: ", ", "))
    scored = evaluation.score_questions(q, r)
    got = scored.select("sql_query_count", "sql_success_rate", "node_latency_total_sec").first()
    assert tuple(got) == (1, 1.0, 1.5)
    writers.write_eval_report(evaluation.eval_summary(scored), scored, str(tmp_path), {"m": "1"})
    assert list((tmp_path / "per_question").glob("part-*.json.gz"))
    assert writers.read_eval_report(spark, str(tmp_path)).count() == 1
