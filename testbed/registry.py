"""Every query with its DuckDB counterpart.

``QUERIES[name]`` takes (spark, sf_dir); ``ORACLE[name]`` is SQL over the
driver's tables. ``plain`` brings results to a common form: doubles rounded,
dates as text, timestamps as epoch seconds, flags as 0/1, text arrays joined.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.functions import scoring
from faultloom.operators import (
    audits, batch_episodes, conversations, dashboard, episodes, evaluation, events, fault_master, frontend,
    observability, quality, rollups, tools, traces,
)
from faultloom.params import Params
from faultloom.plans import incremental
from faultloom.session import measured, run_folder, stored
from faultloom.sources import readers, run_lines, writers
from faultloom.streaming import backfill, engine_episodes, streams
from testbed import traces as tb
from testbed.inputs import (
    CODE, CUSTOMER, DAYS, PARAMS, dtc_history, engine_cycles, history_from_events, table, warehouse,
)
from testbed.oracle import AS_OF, GAP, NUDGE, TODAY, lst, pick, sev, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RECENT = f"event_date >= {TODAY} - {DAYS}"


# counts that Spark gives as int and DuckDB as BIGINT
COUNTS = {
    "longest_active_days", "days_persistence", "failure_count", "planner_error_count", "planner_events_count",
    "planner_fix_attempts_sum", "planner_success_count", "pos", "final_answer_chars", "output_chars", "sql_query_count",
    "sql_success_count", "tool_count", "tool_error_count", "tool_results_count", "sql_events", "evidence_count",
    "node_events_count", "turn", "rank", "score"}


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double") + float(NUDGE), digits)
        elif isinstance(f.dataType, T.IntegerType) and f.name in COUNTS:
            col = col.cast("long")
        elif isinstance(f.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_timestamp(col)
        elif isinstance(f.dataType, T.BooleanType):
            col = col.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            col = F.array_join(col, ",")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def reg(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(measured(spark), sf_dir))

    QUERIES[name] = run
    if oracle:
        ORACLE[name] = sql(oracle)


def w_(fn: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the analytics tables."""
    return lambda s, d: fn(warehouse(s, d), *args, **kwargs)


def p_(fn: Callable, *args) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the flattened trace payloads."""
    return lambda s, d: fn(tb.payloads(s, d), *args)


def r4(*cols: str) -> str:
    return ", ".join(f"round({c}, 4)::DOUBLE AS {c}" for c in cols)


def day(c: str = "event_date", out: str | None = None) -> str:
    return f"CAST({c} AS VARCHAR) AS {out or c}"


# ---------------------------------------------------------------- A. sources
def _kept(s: SparkSession, df: DataFrame) -> str:
    path = f"{run_folder(s)}/source"
    df.write.parquet(path)
    return path


reg("a1_read_dtc_history", lambda s, d: readers.read_dtc_history(s, _kept(s, dtc_history(s, d)), PARAMS.days_ago_ts(DAYS), AS_OF),
    f"""SELECT uniqueid, ts, array_to_string(codes, ',') AS dtc_code, round(lat, 4) AS lat, round(lng, 4) AS lng, pgn AS dtc_pgn
    FROM history WHERE ts > {AS_OF - DAYS * 86400} AND ts <= {AS_OF}""")
reg("a2_read_engine_cycles", lambda s, d: readers.read_engine_cycles(s, _kept(s, engine_cycles(s, d))), "SELECT uniqueid, cycle_ts FROM cyc")
reg("a3_read_vehicle_profile", lambda s, d: warehouse(s, d).profile, "SELECT *, 0::DOUBLE AS tank_capacity FROM profile")
reg("a4_build_vehicle_master", lambda s, d: warehouse(s, d).vm, "SELECT *, 0::DOUBLE AS tank_capacity FROM vm")
_DM_EMPTY = ", ".join(f"'' AS {c}" for c in (
    "secondary_causes", "impact_if_unresolved", "fuel_mileage_impact", "vehicle_health_impact", "safety_risk_level",
    "repair_complexity", "driver_behaviour_category", "driver_behaviour_trigger", "fleet_management_action",
    "recommended_preventive_action", "manufacturer_notes"))
reg("a5_build_dtc_master", lambda s, d: warehouse(s, d).dm,
    f"""SELECT * REPLACE (round(estimated_repair_hours, 4) AS estimated_repair_hours), {_DM_EMPTY},
    0 AS driver_training_required, 0 AS oem_specific FROM dm""")
reg("a6_read_eval_questions", lambda s, d: readers.first_per_dataset(tb.eval_questions(s, d), 7).select("id", "dataset"),
    """SELECT id, dataset FROM (SELECT rid AS id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY c, t) AS rn FROM q0)
    WHERE rn <= 7""")
# files of 50 conversations each, read by the file reader: at most 60 questions of each
reg("a6_question_files", lambda s, d: readers.read_eval_questions(s, [tb.question_files(s, d)], 60).select(
        "id", "question", "expected_intent", "expected_tools"),
    f"""SELECT rid AS id, x AS question, expected_intent,
    CASE WHEN c % 6 = 0 THEN '' ELSE {pick(tb.TOOLS, 'c')} || ',' || {pick(tb.TOOLS, 'c + t')} END AS expected_tools
    FROM (SELECT *, row_number() OVER (PARTITION BY c // 50 ORDER BY c, t) AS rn FROM q0) WHERE rn <= 60""")
reg("a7_filter_questions", lambda s, d: readers.filter_questions(
        tb.eval_questions(s, d), ["R1-1", " R2-0 "], readers.failed_ids(_report(s, d))).select("id", "dataset"),
    "SELECT rid AS id, dataset FROM q0 WHERE len(reasons) > 0 OR rid IN ('R1-1', 'R2-0')")
reg("a8_read_trace_runs", lambda s, d: readers.read_trace_runs(tb.trace_runs(s, d)).select(
        "request_id", "ts", "query", "text", "intent", F.size("trace_log").alias("nodes")),
    "SELECT rid AS request_id, ts, query, x AS text, intent, t % 8 + 1 AS nodes FROM tr")
reg("a8_list_trace_runs", lambda s, d: readers.list_trace_runs(
        tb.trace_runs(s, d), start_date=PARAMS.days_ago(30), env_name="prod", root_cause="All"),
    """SELECT rid AS request_id, rid AS run_id, ts, query, 'fleet_health' AS intent, round(final_score, 4) AS final_score,
    root_cause, env_name, release_version FROM tfinal
    WHERE env_name = 'prod' AND make_timestamp(ts * 1000000)::DATE >= DATE '2024-01-01'""")


_lines: dict[tuple[str, str], str] = {}


def _run_lines(s: SparkSession, d: str) -> str:
    """Stored lines of run records, of which some have other fields and some are damaged; written once per application."""
    key = (s.sparkContext.applicationId, d)
    if key not in _lines:
        folder = run_folder(s)
        tb.run_texts(s, d).write.text(f"{folder}/text")
        run_lines.append_run_lines(s, f"{folder}/text", f"{folder}/lines")
        _lines[key] = f"{folder}/lines"
    return _lines[key]


reg("a8_runs_from_text", lambda s, d: readers.read_trace_runs(run_lines.stored_runs(s, _run_lines(s, d)), ("raw", "drift", "unknown")).select(
        "request_id", "ts", "query", "text", "intent", F.size("trace_log").alias("nodes"), F.col("evaluation.final_score").alias("final_score"),
        F.try_variant_get("raw", "$.cost", "int").alias("cost"), "drift", "unknown"),
    """SELECT rid AS request_id, ts, query, x AS text, intent, t % 8 + 1 AS nodes, CASE WHEN t % 5 <> 1 THEN round(final_score, 4)::DOUBLE END AS final_score,
    CASE WHEN t % 3 = 0 THEN 7 END AS cost, CASE WHEN t % 5 = 1 THEN 'outputs.evaluation.final_score' ELSE '' END AS drift,
    CASE WHEN t % 3 = 0 THEN 'cost' ELSE '' END AS unknown FROM tfinal WHERE c % 13 > 1""")
reg("a8_run_line_counts", lambda s, d: run_lines.line_counts(s, _run_lines(s, d)),
    """SELECT CASE c % 13 WHEN 0 THEN 'not json' WHEN 1 THEN 'not an object' ELSE 'ok' END AS reason, count(*) AS lines FROM tr GROUP BY 1""")


def _written(name: str, mode: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        w, path = warehouse(s, d), f"{run_folder(s)}/{name}"
        layout = writers.layouts()[name]
        if mode == "rebuild":
            # a full build, then one month replaced by itself
            full = w.table(name).drop(layout.partition)
            writers.rebuild(full, path, layout)
            latest = full.select(F.max(F.date_format("event_date", "yyyyMM").cast("int"))).scalar()
            writers.rebuild(full.filter(layout.partition_expr == latest), path, layout, only_touched_partitions=True)
        elif mode == "append":
            full = w.table(name).drop(layout.partition)
            writers.append(full.filter("is_resolved = 0"), path, layout)
            writers.append(full.filter("is_resolved = 1"), path, layout)
        else:
            writers.write_partitioned(w.build(name), path, layout)
        return s.read.parquet(path)
    return run


_VFM_COLS = """episode_id, clientLoginId, uniqueid, vehicle_number, customer_name, model, manufacturing_year, dtc_code,
    system, subsystem, description, severity_level, first_ts, last_ts, CAST(event_date AS VARCHAR) AS event_date,
    occurrence_count, resolution_time_sec, is_resolved, resolution_reason, gap_from_previous_episode, engine_cycles_during,
    driver_related, has_engine_issue, has_coolant_issue, has_safety_issue, has_emission_issue, has_electrical_issue,
    round(vehicle_health_score, 4) AS vehicle_health_score"""
_MONTH = "strftime({}, '%Y%m')::INT AS event_month".format
_EXPLODED = "clientLoginId, uniqueid, vehicle_number, ts, dtc_code, round(lat, 4) AS lat, round(lng, 4) AS lng, dtc_pgn"
reg("a9_write_partitioned", _written("dtc_events_exploded", "write"),
    f"SELECT {_EXPLODED}, CAST(make_timestamp(ts * 1000000)::DATE AS VARCHAR) AS event_day FROM exploded")
reg("a10_latest_by_key", lambda s, d: readers.latest_by_key(
        table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"],
        ["ts", "event_id"]),
    """SELECT user_id, event_type, sec AS ts, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1""")
reg("a11_rebuild", _written("vehicle_fault_master", "rebuild"), f"SELECT {_VFM_COLS}, {_MONTH('event_date')} FROM vfm")
reg("a12_evolve_schema", lambda s, d: writers.evolve_schema(
        table(s, d, "customer").select("c_custkey", "c_name"),
        T.StructType([T.StructField("c_name", T.StringType()), T.StructField("mode", T.StringType()),
                      T.StructField("score", T.DoubleType())]), {"mode": "general"}),
    "SELECT c_name, 'general' AS mode, NULL::DOUBLE AS score, c_custkey FROM customer")
reg("a13_append", _written("vehicle_fault_master", "append"), f"SELECT {_VFM_COLS}, {_MONTH('event_date')} FROM vfm")
reg("a14_validate_outputs", lambda s, d: quality.output_counts({n: warehouse(s, d).table(n) for n in quality.CHECKED}),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {t}" for n, t in (
        ("dtc_events_exploded", "exploded"), ("vehicle_fault_master", "vfm"), ("fleet_health_summary", "fhs"),
        ("fleet_fault_trends", "trends"), ("vehicle_health_summary", "vhs"), ("dtc_fleet_impact", "impact"))))
# the whole check, which raises on empty tables, duplicate keys and shared vehicles
reg("a14_validate", lambda s, d: s.createDataFrame(sorted(warehouse(s, d).validate().items()), "table_name string, rows long"),
    """SELECT 'dtc_events_exploded' AS table_name, count(*) AS rows FROM exploded UNION ALL SELECT 'vehicle_fault_master', count(*) FROM vfm
    UNION ALL SELECT 'fleet_health_summary', count(*) FROM fhs UNION ALL SELECT 'fleet_fault_trends', count(*) FROM trends
    UNION ALL SELECT 'vehicle_health_summary', count(*) FROM vhs UNION ALL SELECT 'dtc_fleet_impact', count(*) FROM impact""")
reg("a14_duplicate_keys", lambda s, d: quality.duplicate_keys({n: warehouse(s, d).table(n) for n in quality.UNIQUE_KEYS}),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) - count(DISTINCT ({k})) AS duplicates FROM {t}" for n, k, t in (
        ("vehicle_fault_master", "episode_id", "vfm"), ("fleet_health_summary", "clientLoginId", "fhs"),
        ("vehicle_health_summary", "clientLoginId, uniqueid", "vhs"), ("dtc_fleet_impact", "clientLoginId, dtc_code", "impact"),
        ("fleet_fault_trends", "clientLoginId, date", "trends"))))


def _report(s: SparkSession, d: str) -> DataFrame:
    # stored: the summary and the rows of the report both read the scores
    scored = stored(evaluation.score_questions(tb.eval_questions(s, d), tb.eval_results(s, d)))
    folder = run_folder(s)
    writers.write_eval_report(evaluation.eval_summary(scored), scored, folder, {"model_name": "m1"})
    return writers.read_eval_report(s, folder, T.StructType([
        T.StructField("id", T.StringType()), T.StructField("tool_f1", T.DoubleType()),
        T.StructField("keyword_hits", T.DoubleType()), T.StructField("failure_reasons", T.ArrayType(T.StringType()))]))


reg("a15_write_eval_report", lambda s, d: _report(s, d).drop("failure_reasons"), "SELECT id, tool_f1, keyword_hits FROM scored")
_OPTIONS = ("intent", "root_cause", "env_name", "release_version")
reg("a16_distinct_filter_options", lambda s, d: quality.distinct_filter_options(
        tb.stored(s, d, "trace_requests"), _OPTIONS).unionByName(quality.distinct_filter_options(
            tb.stored(s, d, "trace_prompt_scores"), ("prompt_key", "prompt_version"))),
    " UNION ".join([f"SELECT '{c}' AS option, {c} AS value FROM tr WHERE {c} <> ''" for c in _OPTIONS]
                   + [f"SELECT '{c}' AS option, {c} AS value FROM tpscore" for c in ("prompt_key", "prompt_version")]))

# ---------------------------------------------------------------- B. ingest
reg("b1_explode_codes", lambda s, d: events.explode_codes(dtc_history(s, d)).select("uniqueid", "ts", "dtc_code"),
    "SELECT uniqueid, ts, unnest(codes) AS dtc_code FROM history")
reg("b2_drop_null_code", lambda s, d: events.drop_null_code(events.explode_codes(dtc_history(s, d))).groupBy("dtc_code").agg(
        F.count("*").alias("events")),
    "SELECT dtc_code, count(*) AS events FROM (SELECT unnest(codes) AS dtc_code FROM history) WHERE dtc_code <> '0' GROUP BY ALL")
reg("b3_events_exploded", lambda s, d: warehouse(s, d).build("dtc_events_exploded"), f"SELECT {_EXPLODED} FROM exploded")
reg("b4_analytics_window", lambda s, d: events.analytics_window(
        dtc_history(s, d), Params(as_of=AS_OF, window_days=DAYS)).groupBy("uniqueid").agg(F.count("*").alias("messages")),
    f"SELECT uniqueid, count(*) AS messages FROM history WHERE ts > {AS_OF - DAYS * 86400} AND ts <= {AS_OF} GROUP BY ALL")


def _cdc(s: SparkSession, d: str) -> DataFrame:
    """Bootstrap, record the run, then the second window from its checkpoint."""
    folder = run_folder(s)
    first = incremental.cdc_window(None, "dtc", AS_OF - 5 * 86400)
    history = dtc_history(s, d)
    seen = readers.within(history, "ts", first.since_ts, first.until_ts).count()
    incremental.record_run(s, folder, "dtc", first, seen)
    checkpoints = s.read.parquet(f"{folder}/cdc_checkpoint")
    second = incremental.cdc_window(checkpoints, "dtc", AS_OF, replay_hours=1)
    new = readers.within(history, "ts", second.since_ts, second.until_ts)
    log = s.read.parquet(f"{folder}/cdc_run_log").select("pipeline", "since_ts", "until_ts", "rows")
    return log.unionByName(new.agg(F.count("*").alias("rows")).select(
        F.lit("next").alias("pipeline"), F.lit(second.since_ts).alias("since_ts"), F.lit(second.until_ts).alias("until_ts"), "rows"))


_T1 = AS_OF - 5 * 86400
reg("b5_cdc_window", _cdc,
    " UNION ALL ".join(f"SELECT '{n}' AS pipeline, {a}::BIGINT AS since_ts, {b}::BIGINT AS until_ts, count(*) AS rows FROM history WHERE ts > {a} AND ts <= {b}"
                       for n, a, b in (("dtc", _T1 - 90 * 86400, _T1), ("next", _T1 - 3600, AS_OF))))


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    """One checkpoint row per day of messages, the current one per pipeline."""
    k = F.floor(F.unix_timestamp("ts") / 86400)
    rows = dtc_history(s, d).groupBy(F.concat(F.lit("p"), (k % 3).cast("string")).alias("pipeline"), k.alias("updated_at")).agg(
        F.max(F.unix_timestamp("ts")).alias("checkpoint_ts"))
    return incremental.current_checkpoints(rows)


reg("b6_cdc_checkpoint", _checkpoints,
    """SELECT 'p' || (ts // 86400 % 3) AS pipeline, max(ts // 86400) AS updated_at, max(ts) AS checkpoint_ts FROM history
    GROUP BY ALL""")


def _impacted(s: SparkSession, d: str) -> DataFrame:
    """Yesterday's fault master brought to today by rebuilding impacted vehicles."""
    from faultloom.plans.pipeline import Warehouse
    from testbed.inputs import dtc_codes, vehicle_profile

    w = warehouse(s, d)
    before = Params(as_of=AS_OF - 2 * 86400, gap=PARAMS.gap, cutoff=PARAMS.cutoff, k=PARAMS.k)
    history, cycles = dtc_history(s, d), engine_cycles(s, d)
    # what had arrived by then
    old = Warehouse(s, history=history, cycles=cycles.filter(F.col("cycle_end_ts") <= F.timestamp_seconds(F.lit(before.as_of)).cast("timestamp_ntz")),
                    profile=vehicle_profile(s, d), codes=dtc_codes(s, d), params=before)
    ids = incremental.impacted_vehicles(
        old.vfm, readers.within(history, "ts", before.as_of, AS_OF),
        w.cycles.filter(F.col("cycle_ts") > before.as_of), PARAMS)
    return incremental.rebuild_impacted(old.vfm, ids, history, w.cycles, w.vm, w.dm, PARAMS)


reg("b7_rebuild_impacted", _impacted, f"SELECT {_VFM_COLS} FROM vfm")


def _incremental(s: SparkSession, d: str) -> DataFrame:
    """Two runs, two days apart, on what had arrived by then; roll-ups from the result."""
    from faultloom.plans.pipeline import Warehouse
    from testbed.inputs import dtc_codes, vehicle_profile

    w, folder, history = warehouse(s, d), run_folder(s), dtc_history(s, d)
    for as_of in (AS_OF - 2 * 86400, AS_OF):
        p = Params(as_of=as_of, gap=PARAMS.gap, cutoff=PARAMS.cutoff, k=PARAMS.k)
        arrived = history.filter(F.unix_timestamp("ts") <= as_of)
        vfm = incremental.run_incremental(s, folder, arrived, w.cycles.filter(F.col("cycle_ts") <= as_of), w.vm, w.dm, p)
    again = Warehouse(s, history=history, cycles=engine_cycles(s, d), profile=vehicle_profile(s, d), codes=dtc_codes(s, d), params=PARAMS)
    return again.take("vehicle_fault_master", vfm).vhs.select("clientLoginId", "uniqueid", "active_fault_count", "total_episodes", "most_common_dtc")


reg("b7_run_incremental", _incremental, "SELECT clientLoginId, uniqueid, active_fault_count, total_episodes, most_common_dtc FROM vhs")


def _stored_runs(s: SparkSession, d: str) -> DataFrame:
    return tb.turns(s, d).filter("t % 3 = 0").select(
        F.concat(F.lit("R"), F.col("c").cast("string"), F.lit("-"), F.col("t").cast("string")).alias("request_id"))


def _sync_cutoff():
    return incremental.sync_cutoff(None, "runs", datetime(2024, 1, 16, tzinfo=timezone.utc), lookback_days=14)


def _sync(s: SparkSession, d: str) -> DataFrame:
    runs, existing = tb.trace_runs(s, d), _stored_runs(s, d)
    # two rounds, the first smaller than the backlog; the second starts from the first one's state
    now, folder = datetime(2024, 1, 16, tzinfo=timezone.utc), run_folder(s)
    state, reports = None, []
    for batch in (50, None):
        path = f"{folder}/runs{len(reports)}"
        new, report, fresh = incremental.sync_runs(
            runs, existing, state, "runs", now, lookback_days=14, batch=batch, store=lambda df, p=path: df.select("id").write.parquet(p))
        stored = s.read.parquet(path).select(F.col("id").alias("request_id"))
        fresh.write.parquet(f"{folder}/state{len(reports)}")
        state, existing = s.read.parquet(f"{folder}/state{len(reports)}"), existing.unionByName(stored)
        reports.append(stored)
    return reports[0].withColumn("round", F.lit(1)).unionByName(reports[1].withColumn("round", F.lit(2)))


reg("b8_sync_runs", _sync,
    """SELECT rid AS request_id, CASE WHEN row_number() OVER (ORDER BY ts, rid) <= 50 THEN 1 ELSE 2 END::INT AS round
    FROM tr WHERE ts >= 1704153600 AND t % 3 <> 0""")
reg("b8_sync_report", lambda s, d: incremental.sync_report(tb.trace_runs(s, d), _stored_runs(s, d), _sync_cutoff()),
    """SELECT count(*) AS fetched, count(*) FILTER (ok) AS eligible, 0::BIGINT AS skipped_empty, count(*) FILTER (ok AND t % 3 = 0) AS skipped_existing,
    count(*) FILTER (ok AND t % 3 <> 0) AS inserted, 0::BIGINT AS failed, max(ts) FILTER (ok) AS watermark
    FROM (SELECT *, ts >= 1704153600 AS ok FROM tr)""")


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of messages with proper timestamps."""
    schema = table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    history = history_from_events(raw)
    return history.withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(build: Callable[[DataFrame], DataFrame], update: bool = False) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        w, folder = warehouse(s, d), run_folder(s)
        events_ = streams.stream_events_exploded(_event_stream(s, d), w.vm, PARAMS)
        start = streams.keep_latest_in if update else streams.append_to
        query = start(build(events_), f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
        return streams.latest_state(streams.read_state(s, f"{folder}/out")) if update else s.read.parquet(f"{folder}/out")
    return run


reg("b9_stream_events_exploded", _streamed(lambda e: e), f"SELECT {_EXPLODED} FROM exploded")


def _deduped(s: SparkSession, d: str) -> DataFrame:
    """Every message delivered twice; the second delivery is dropped."""
    w, folder = warehouse(s, d), run_folder(s)
    twice = _event_stream(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    live = streams.stream_events_exploded(twice, w.vm, PARAMS, dedupe_within="1 hour").select("uniqueid", "dtc_code", "ts")
    streams.append_to(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/out")


reg("b9_stream_events_deduplicated", _deduped, "SELECT DISTINCT uniqueid, dtc_code, ts FROM exploded")
reg("b10_stream_episodes", _streamed(lambda e: streams.stream_episodes(e, GAP, "2 hours")),
    f"""SELECT uniqueid, dtc_code, first_ts, last_ts, occurrences, last_ts - first_ts AS persistence_sec FROM bepi
    WHERE last_ts + {GAP} <= (SELECT max(ts) - 7200 FROM exploded)""")
reg("b11_stream_daily_trend", _streamed(lambda e: streams.stream_daily_trend(e, "2 hours")),
    """SELECT clientLoginId, CAST(make_timestamp(ts * 1000000)::DATE AS VARCHAR) AS date, count(*) AS events FROM exploded
    WHERE (ts // 86400 + 1) * 86400 <= (SELECT max(ts) - 7200 FROM exploded) GROUP BY ALL""")
reg("b12_stream_latest_state", _streamed(streams.stream_latest_state, update=True),
    "SELECT uniqueid, dtc_code, max(ts) AS last_dtc_ts, count(*) AS events FROM exploded GROUP BY ALL")



def _cycles_until(s: SparkSession, d: str, folder: str) -> DataFrame:
    """The cycles as a stream of files, and one much later row of no vehicle, behind which the watermark passes all others."""
    shape = "uniqueid string, cycle_ts long"
    warehouse(s, d).cycles.select("uniqueid", "cycle_ts").unionByName(s.createDataFrame([("", AS_OF + 60 * 86400)], shape)).write.parquet(f"{folder}/cycles")
    return s.readStream.schema(shape).parquet(f"{folder}/cycles")


def _engine_episodes(s: SparkSession, d: str) -> DataFrame:
    w, folder = warehouse(s, d), run_folder(s)
    live = engine_episodes.stream_engine_episodes(
        streams.stream_events_exploded(_event_stream(s, d), w.vm, PARAMS), _cycles_until(s, d, folder), PARAMS, "2 hours")
    engine_episodes.append_keyed(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/out")


WITHIN = 7 * 86400


def _stream_resolution(s: SparkSession, d: str) -> DataFrame:
    w, folder = warehouse(s, d), run_folder(s)
    found = w.table("fault_episodes").select("uniqueid", "dtc_code", "first_ts", "last_ts", "occurrence_count", "engine_cycles_during")
    late = AS_OF + 60 * 86400
    found.unionByName(s.createDataFrame([("", "", late, late, 0, 0)], engine_episodes.EPISODE)).write.parquet(f"{folder}/episodes")
    closed = s.readStream.schema(engine_episodes.EPISODE).parquet(f"{folder}/episodes")
    live = engine_episodes.stream_resolution(closed, _cycles_until(s, d, folder), "2 hours", WITHIN)
    streams.append_to(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/out").filter("uniqueid <> ''").select(
        "uniqueid", "dtc_code", "first_ts", "last_ts", "resolution_time_sec", "is_resolved")


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    """A part of the messages as history, the others as files that come later, old and new ones mixed."""
    w, folder = warehouse(s, d), run_folder(s)
    history = dtc_history(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    later = F.pmod(F.xxhash64("uniqueid", "ts"), F.lit(3)) == 0
    history.filter(~later).write.parquet(f"{folder}/in/history")
    backfill.backfill_events(s, f"{folder}/in", history.schema, w.vm, f"{folder}/out", PARAMS)
    history.filter(later).write.parquet(f"{folder}/in/later")
    backfill.continue_events(s, f"{folder}/in", history.schema, w.vm, f"{folder}/out", PARAMS).awaitTermination()
    return backfill.continuous_events(s, f"{folder}/out")


reg("b9_backfill_and_stream", _backfilled, f"SELECT {_EXPLODED} FROM exploded")
reg("b10_stream_engine_episodes", _engine_episodes,
    """SELECT e.uniqueid, e.dtc_code, e.first_ts, e.last_ts, e.occurrence_count, coalesce(d.n, 0) AS engine_cycles_during FROM epi e
    LEFT JOIN during d ON d.uniqueid = e.uniqueid AND d.dtc_code = e.dtc_code AND d.episode_no = e.episode_no""")
reg("c7_stream_resolution", _stream_resolution,
    f"""SELECT uniqueid, dtc_code, first_ts, last_ts, last_ts - first_ts AS resolution_time_sec,
    CASE WHEN EXISTS (SELECT 1 FROM cyc c WHERE c.uniqueid = e.uniqueid AND c.cycle_ts > e.last_ts AND c.cycle_ts <= e.last_ts + {WITHIN})
    THEN 1 ELSE 0 END AS is_resolved FROM epi e""")

# ---------------------------------------------------------------- C. episodes


def _numbered(s: SparkSession, d: str) -> DataFrame:
    w = warehouse(s, d)
    return episodes.number_event_seconds(episodes.event_seconds(w.events), w.cycles, PARAMS)


def _episodes(s: SparkSession, d: str) -> DataFrame:
    w = warehouse(s, d)
    return episodes.episode_agg(episodes.event_seconds(w.events), w.cycles, PARAMS)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    w = warehouse(s, d)
    return episodes.resolved_episodes(w.events, w.cycles, PARAMS)


reg("c1_previous_event", lambda s, d: episodes.previous_event(warehouse(s, d).events).drop("n"),
    "SELECT uniqueid, dtc_code, ts, prev_ts FROM lagged")
reg("c2_engine_boundary", lambda s, d: _numbered(s, d).select("uniqueid", "dtc_code", "ts", "has_boundary"),
    "SELECT uniqueid, dtc_code, ts, has_boundary FROM bounded")
reg("c3_break_flag", lambda s, d: _numbered(s, d).select("uniqueid", "dtc_code", "ts", "is_break"),
    "SELECT uniqueid, dtc_code, ts, is_break FROM broken")
reg("c4_episode_number", lambda s, d: _numbered(s, d).select("uniqueid", "dtc_code", "ts", "episode_no"),
    "SELECT uniqueid, dtc_code, ts, episode_no FROM numbered")
reg("c5_episode_agg", lambda s, d: _episodes(s, d).drop("engine_cycles_during"),
    "SELECT uniqueid, dtc_code, episode_no, first_ts, last_ts, occurrence_count FROM epi")
reg("c6_last_engine_cycle", lambda s, d: episodes.last_engine_cycle(warehouse(s, d).cycles), "SELECT * FROM maxcyc")
reg("c7_resolution", lambda s, d: episodes.resolution(_episodes(s, d), warehouse(s, d).cycles, PARAMS).select(
        "uniqueid", "dtc_code", "episode_no", "resolution_time_sec", "is_resolved"),
    "SELECT uniqueid, dtc_code, episode_no, resolution_time_sec, is_resolved FROM resolved")
reg("c8_gap_from_previous_episode", lambda s, d: episodes.gap_from_previous_episode(_episodes(s, d)).select(
        "uniqueid", "dtc_code", "episode_no", "gap_from_previous_episode"),
    "SELECT uniqueid, dtc_code, episode_no, gap_from_previous_episode FROM resolved")
reg("c9_episode_counts", lambda s, d: episodes.episode_counts(_episodes(s, d)), "SELECT * FROM epcount")
reg("c10_severity_multiplier", lambda s, d: warehouse(s, d).dm.select(
        "dtc_code", scoring.severity_multiplier("severity_level").alias("multiplier")),
    f"SELECT dtc_code, {sev('severity_level')} AS multiplier FROM dm")
reg("c11_duration_factor", lambda s, d: warehouse(s, d).vfm.select(
        "episode_id", scoring.duration_factor("resolution_time_sec").alias("factor")),
    "SELECT episode_id, round(1 + least(resolution_time_sec::DOUBLE / 86400, 30) / 10, 4)::DOUBLE AS factor FROM vfm")
reg("c12_recurrence_factor", lambda s, d: episodes.episode_counts(_episodes(s, d)).select(
        "uniqueid", "dtc_code", scoring.recurrence_factor("ep_count").alias("factor")),
    "SELECT uniqueid, dtc_code, (1 + (ep_count - 1) * 0.5)::DOUBLE AS factor FROM epcount")
reg("c13_vehicle_risk", lambda s, d: fault_master.vehicle_risk(_resolved(s, d), warehouse(s, d).dm),
    "SELECT uniqueid, round(risk, 4) AS risk FROM risk")
reg("c14_health_score", lambda s, d: fault_master.vehicle_risk(_resolved(s, d), warehouse(s, d).dm).select(
        "uniqueid", scoring.health_score("risk", PARAMS.k).alias("health_score")),
    "SELECT uniqueid, round(greatest(0, 100 - least(risk * 0.2::DOUBLE, 100)), 4)::DOUBLE AS health_score FROM risk")
reg("c15_engine_cycles_during", lambda s, d: episodes.engine_cycles_during(
        batch_episodes.episodes_gap_only(warehouse(s, d).events, GAP), warehouse(s, d).cycles, PARAMS).select(
        "uniqueid", "dtc_code", "episode_no", "engine_cycles_during"),
    """SELECT e.uniqueid, e.dtc_code, e.episode_no, count(c.cycle_ts) AS engine_cycles_during FROM bepi e LEFT JOIN cyc c
    ON c.uniqueid = e.uniqueid AND c.cycle_ts >= e.first_ts AND c.cycle_ts <= e.last_ts GROUP BY ALL""")
_ISSUES = ("engine", "coolant", "safety", "emission", "electrical")
reg("c16_issue_flags", lambda s, d: warehouse(s, d).dm.select("dtc_code", *[v.alias(k) for k, v in scoring.issue_flags().items()]),
    """SELECT dtc_code, (lower(subsystem) LIKE '%powertrain%' OR lower(system) LIKE '%engine%')::INT AS has_engine_issue,
    (lower(subsystem) LIKE '%coolant%')::INT AS has_coolant_issue, (lower(system) LIKE '%safety%')::INT AS has_safety_issue,
    (lower(subsystem) LIKE '%emission%' OR lower(system) LIKE '%emission%')::INT AS has_emission_issue,
    (lower(subsystem) LIKE '%electrical%' OR lower(system) LIKE '%electrical%')::INT AS has_electrical_issue FROM dm""")
reg("c17_clean_text", lambda s, d: warehouse(s, d).dm.select(
        "dtc_code", scoring.clean_text("system").alias("system"), scoring.clean_text("subsystem").alias("subsystem"),
        scoring.clean_text("description", none_word=False).alias("description")),
    """SELECT dtc_code, CASE WHEN system IN ('nan', 'None') THEN '' ELSE system END AS system,
    CASE WHEN subsystem IN ('nan', 'None') THEN '' ELSE subsystem END AS subsystem, description FROM dm""")
reg("c18_clamp_severity", lambda s, d: warehouse(s, d).dm.select(
        "dtc_code", scoring.clamp_severity("severity_level").alias("severity_level")),
    "SELECT dtc_code, greatest(severity_level, 1) AS severity_level FROM dm")
reg("c19_episode_key", lambda s, d: _episodes(s, d).select(
        scoring.episode_key().alias("episode_id"), scoring.event_date("first_ts").alias("event_date")),
    f"SELECT episode_id, {day()} FROM vfm")


def _fault_master(s: SparkSession, d: str) -> DataFrame:
    """From raw messages to fault rows in one plan, nothing stored in between."""
    w = warehouse(s, d)
    return fault_master.vehicle_fault_master(w.build("dtc_events_exploded"), w.cycles, w.vm, w.dm, PARAMS)


reg("c20_vehicle_fault_master", _fault_master, f"SELECT {_VFM_COLS} FROM vfm")


def _batch(s: SparkSession, d: str) -> DataFrame:
    """The batch variant's input: events with code texts and unusable rows."""
    w = warehouse(s, d)
    codes = w.dm.select("dtc_code", "description", "severity_level", "subsystem", "system")
    rows = w.events.join(fault_master.occurring(codes, w.events), "dtc_code", "left")
    good = rows.select(
        "uniqueid", F.col("ts").cast("string").alias("ts"), "dtc_code", F.col("dtc_code").alias("code"), "dtc_pgn",
        F.when(F.col("lat") != 0, F.col("lat")).alias("lat"), "lng", "description", "severity_level", "subsystem", "system")
    return good.unionByName(good.filter("dtc_code = 'P0000'").withColumn("ts", F.lit("bad")))


def _batch_resolved(s: SparkSession, d: str) -> DataFrame:
    return batch_episodes.resolution_by_next_cycle(_batch(s, d), warehouse(s, d).cycles, GAP, PARAMS.cutoff)


reg("c21_episodes_gap_only", lambda s, d: batch_episodes.episodes_gap_only(_batch(s, d), GAP),
    "SELECT *, last_ts - first_ts AS persistence_sec FROM bepi")
reg("c22_resolution_by_next_cycle", lambda s, d: _batch_resolved(s, d).drop("episode_id"),
    "SELECT * EXCLUDE (episode_id) REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM bres")
reg("c23_deterministic_episode_id", lambda s, d: batch_episodes.episodes_gap_only(_batch(s, d), GAP).select(
        "uniqueid", "dtc_code", "episode_no", batch_episodes.deterministic_episode_id().alias("episode_id")),
    "SELECT uniqueid, dtc_code, episode_no, episode_id FROM bres")
reg("c24_dtc_state", lambda s, d: batch_episodes.dtc_state(_batch_resolved(s, d), warehouse(s, d).cycles),
    """SELECT uniqueid, dtc_code, last_ts AS last_dtc_ts, coalesce(max_cycle_ts, 0) AS last_engine_on_ts,
    1 - is_resolved AS is_active, episode_id AS last_episode_id FROM (SELECT *, row_number() OVER
    (PARTITION BY uniqueid, dtc_code ORDER BY episode_no DESC) AS rn FROM bres) LEFT JOIN maxcyc USING (uniqueid) WHERE rn = 1""")
reg("c25_events_enriched", lambda s, d: batch_episodes.events_enriched(_batch(s, d), AS_OF),
    f"""SELECT e.uniqueid, e.ts, e.ts AS event_time, e.dtc_code, e.dtc_pgn, round(e.lat, 4) AS lat, round(e.lng, 4) AS lng,
    e.dtc_code AS code, coalesce(dm.description, '') AS description, coalesce(dm.severity_level, 0) AS severity_level,
    coalesce(dm.subsystem, '') AS subsystem, coalesce(dm.system, '') AS system, {AS_OF}::BIGINT AS ingestion_ts
    FROM exploded e LEFT JOIN dm USING (dtc_code)""")

# ---------------------------------------------------------------- D. analytics tables
reg("d1_fleet_health_summary", lambda s, d: warehouse(s, d).build("fleet_health_summary"),
    "SELECT * REPLACE (round(fleet_health_score, 4)::DOUBLE AS fleet_health_score) FROM fhs")
reg("d1a_weighted_mode", lambda s, d: rollups.weighted_mode(
        warehouse(s, d).vfm, ["clientLoginId"], "dtc_code", "occurrence_count", "top"), "SELECT * FROM tcode_mode")
reg("d1b_active_fault_trend", lambda s, d: warehouse(s, d).build("fleet_health_summary").select("clientLoginId", "active_fault_trend"),
    "SELECT clientLoginId, active_fault_trend FROM fhs")
reg("d2_fleet_dtc_distribution", lambda s, d: warehouse(s, d).build("fleet_dtc_distribution"),
    "SELECT * REPLACE (round(avg_resolution_time, 4)::DOUBLE AS avg_resolution_time) FROM distribution")
reg("d3_fleet_system_health", lambda s, d: warehouse(s, d).build("fleet_system_health"),
    "SELECT * REPLACE (round(risk_score, 4)::DOUBLE AS risk_score) FROM systems")
reg("d4_fleet_fault_trends", lambda s, d: warehouse(s, d).build("fleet_fault_trends"),
    "SELECT * REPLACE (CAST(date AS VARCHAR) AS date, round(fleet_health_score, 4)::DOUBLE AS fleet_health_score) FROM trends")
reg("d5_vehicle_health_summary", lambda s, d: warehouse(s, d).build("vehicle_health_summary"),
    """SELECT * REPLACE (round(vehicle_health_score, 4)::DOUBLE AS vehicle_health_score,
    round(avg_resolution_time, 4)::DOUBLE AS avg_resolution_time) FROM vhs""")
reg("d6_dtc_fleet_impact", lambda s, d: warehouse(s, d).build("dtc_fleet_impact"),
    f"SELECT * REPLACE ({r4('avg_resolution_time', 'driver_related_ratio', 'fleet_risk_score')}) FROM impact")
reg("d7_maintenance_candidates", lambda s, d: rollups.maintenance_candidates(
        warehouse(s, d).vfm, warehouse(s, d).stats, warehouse(s, d).dm),
    f"SELECT * REPLACE ({r4('maintenance_priority_score')}) FROM candidates")
reg("d7_maintenance_priority", lambda s, d: warehouse(s, d).build("maintenance_priority"),
    f"SELECT * REPLACE ({r4('maintenance_priority_score')}) FROM maintenance")
reg("d8_dtc_cooccurrence", lambda s, d: warehouse(s, d).build("dtc_cooccurrence"), "SELECT * FROM cooccurrence")
reg("d8_dtc_cooccurrence_unstored", lambda s, d: rollups.dtc_cooccurrence(warehouse(s, d).stats),
    "SELECT * FROM cooccurrence")


_kept_rollups: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _rollup(name: str) -> Callable:
    """A roll-up that was built two days before and brought forward since; both runs are made once per application."""
    def run(s: SparkSession, d: str) -> DataFrame:
        key = (s.sparkContext.applicationId, d)
        if key not in _kept_rollups:
            w, folder, history = warehouse(s, d), run_folder(s), dtc_history(s, d)
            for as_of in (AS_OF - 2 * 86400, AS_OF):
                p = Params(as_of=as_of, gap=PARAMS.gap, cutoff=PARAMS.cutoff, k=PARAMS.k)
                arrived = history.filter(F.unix_timestamp("ts") <= as_of)
                kept = incremental.run_rollups(s, folder, arrived, w.cycles.filter(F.col("cycle_ts") <= as_of), w.vm, w.dm, p, buckets=8)
            _kept_rollups[key] = kept
        return _kept_rollups[key][name]
    return run


for _built in (
        "d1_fleet_health_summary", "d2_fleet_dtc_distribution", "d3_fleet_system_health", "d4_fleet_fault_trends",
        "d5_vehicle_health_summary", "d6_dtc_fleet_impact", "d7_maintenance_priority", "d8_dtc_cooccurrence"):
    _name = _built.split("_", 1)[1]
    reg(f"b7_kept_{_name}", _rollup(_name))
    ORACLE[f"b7_kept_{_name}"] = ORACLE[_built]

# ---------------------------------------------------------------- E. dashboard
CUST = f"customer_name = '{CUSTOMER}'"
OWN_TENANTS = f"clientLoginId IN (SELECT clientLoginId FROM vm WHERE {CUST})"


def both(name: str, fn: Callable, oracle: Callable[[str], str], *args, where: str = CUST, **kwargs) -> None:
    """A query for all customers and for one."""
    reg(name, w_(fn, *args, **kwargs), oracle("TRUE"))
    reg(f"{name}_customer", w_(fn, *args, customer=CUSTOMER, **kwargs), oracle(where))


reg("e1_customer_names", w_(dashboard.customer_names), "SELECT DISTINCT customer_name FROM vhs WHERE customer_name <> ''")
reg("e2_customer_vehicles", w_(dashboard.customer_vehicles, CUSTOMER), f"SELECT uniqueid, vehicle_number FROM vhs WHERE {CUST}")
both("e3_fleet_kpis", dashboard.fleet_kpis, lambda c: f"""SELECT * FROM (SELECT count(*) AS total_vehicles,
    count(*) FILTER (active_fault_count > 0) AS vehicles_with_dtcs, count(*) FILTER (critical_fault_count > 0) AS critical_vehicles,
    round(avg(vehicle_health_score), 2) AS fleet_health_score FROM vhs WHERE {c}), (SELECT
    round(coalesce(avg(resolution_time_sec::DOUBLE / 86400) FILTER (is_resolved = 1 AND {RECENT} AND resolution_time_sec > 0), 0), 1) AS avg_resolution_days,
    count(DISTINCT uniqueid) FILTER (is_resolved = 0 AND severity_level >= 3) AS maintenance_due,
    coalesce(sum(occurrence_count) FILTER ({RECENT}), 0)::BIGINT AS total_dtc_alerts,
    count(*) FILTER (severity_level >= 3 AND {RECENT}) AS critical_alerts FROM vfm WHERE {c})""", days=DAYS)
both("e4_fleet_overview", dashboard.fleet_overview, lambda c: f"""SELECT count(*) AS total_vehicles,
    count(*) FILTER (active_fault_count > 0) AS active_fault_vehicles, count(*) FILTER (critical_fault_count > 0) AS critical_fault_vehicles,
    round(avg(vehicle_health_score), 4) AS fleet_health_score, '2024-01-31' AS event_date FROM vhs WHERE {c}""")
both("e5_fleet_trend", dashboard.fleet_trend, lambda c: f"""SELECT {day()}, count(DISTINCT uniqueid) AS active_fault_vehicles,
    count(DISTINCT uniqueid) FILTER (severity_level >= 3) AS critical_fault_vehicles, round(avg(vehicle_health_score), 4) AS fleet_health_score
    FROM vfm WHERE {RECENT} AND is_resolved = 0 AND {c} GROUP BY vfm.event_date""", days=DAYS)
both("e6_top_risk_vehicles", dashboard.top_risk_vehicles, lambda c: f"""SELECT vs.uniqueid, vs.vehicle_number,
    coalesce(m.model, '') AS vehicle_model, vs.customer_name, round(vs.vehicle_health_score, 4)::DOUBLE AS health_score,
    vs.active_fault_count, vs.critical_fault_count, coalesce(max(date_diff('day', ep.event_date, {TODAY})), 0) AS longest_active_days
    FROM vhs vs LEFT JOIN vm m ON m.uniqueid = vs.uniqueid LEFT JOIN vfm ep ON ep.uniqueid = vs.uniqueid AND ep.is_resolved = 0
    WHERE vs.active_fault_count > 0 AND {c.replace('customer_name', 'vs.customer_name')}
    GROUP BY vs.uniqueid, vs.vehicle_number, m.model, vs.customer_name, vs.vehicle_health_score, vs.active_fault_count, vs.critical_fault_count
    ORDER BY vs.critical_fault_count DESC, vs.vehicle_health_score, vs.active_fault_count DESC, vs.uniqueid LIMIT 20""")
_SUMMARY = """SELECT dtc_code, sum(occurrence_count)::BIGINT AS occurrences, count(DISTINCT uniqueid) AS vehicles_affected,
    round(avg(resolution_time_sec::DOUBLE / 86400), 4) AS avg_persistence FROM vfm WHERE {} GROUP BY ALL"""
both("e7_dtc_summary", dashboard.dtc_summary, lambda c: _SUMMARY.format(f"{RECENT} AND {c}") + " ORDER BY occurrences DESC, dtc_code LIMIT 15", days=DAYS)
both("e8_top_dtc_codes", dashboard.top_dtc_codes, lambda c: f"""SELECT v.dtc_code, CASE WHEN coalesce(d.description, '') = ''
    THEN 'DTC ' || v.dtc_code ELSE d.description END AS description, sum(occurrence_count)::BIGINT AS occurrences,
    count(DISTINCT uniqueid) AS vehicles_affected FROM vfm v LEFT JOIN dm d ON d.dtc_code = v.dtc_code WHERE {RECENT} AND {c}
    GROUP BY v.dtc_code, d.description ORDER BY occurrences DESC, v.dtc_code LIMIT 10""", days=DAYS)
both("e9_severity_breakdown", dashboard.severity_breakdown, lambda c: f"""SELECT level, n AS count, round(n::DOUBLE / sum(n) OVER () * 100, 1) AS percentage
    FROM (SELECT CASE WHEN severity_level >= 3 THEN 'Critical' WHEN severity_level = 2 THEN 'Moderate' ELSE 'Minor' END AS level,
    count(*) AS n FROM vfm WHERE {RECENT} AND {c} GROUP BY ALL)""", days=DAYS)
both("e10_dtc_trend", dashboard.dtc_trend, lambda c: f"""SELECT {day()}, sum(occurrence_count)::BIGINT AS occurrences FROM vfm
    WHERE dtc_code = '{CODE}' AND {RECENT} AND {c} GROUP BY vfm.event_date""", CODE, days=DAYS)
both("e11_dtc_alerts_trend", dashboard.dtc_alerts_trend, lambda c: f"""SELECT {day()}, sum(occurrence_count)::BIGINT AS total_alerts,
    count(*) FILTER (severity_level >= 3) AS critical_alerts FROM vfm WHERE {RECENT} AND {c} GROUP BY vfm.event_date""", days=DAYS)
_AFFECTED = """SELECT uniqueid, count(*) AS episode_count, count(*) FILTER (is_resolved = 0) AS active_episodes,
    max(severity_level) AS max_severity FROM vfm WHERE {} GROUP BY uniqueid
    ORDER BY active_episodes DESC, max_severity DESC, episode_count DESC, uniqueid LIMIT 100"""
both("e12_dtc_affected_vehicles", dashboard.dtc_affected_vehicles, lambda c: _AFFECTED.format(f"dtc_code = '{CODE}' AND {c}"), CODE)
both("e13_selected_dtc_kpis", dashboard.selected_dtc_kpis, lambda c: f"""SELECT min(system) AS system, min(subsystem) AS subsystem,
    count(DISTINCT uniqueid) AS affected_vehicles, count(*) FILTER (is_resolved = 0) AS active_episodes,
    count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_episodes,
    round(coalesce(avg(resolution_time_sec::DOUBLE / 86400) FILTER (is_resolved = 1 AND resolution_time_sec > 0), 0), 1) AS avg_resolution_days,
    round((count(*) FILTER (driver_related = 1))::DOUBLE / count(*), 3) AS driver_related_ratio, CAST(max(event_date) AS VARCHAR) AS last_seen_date,
    '{CODE}' AS dtc_code FROM vfm WHERE dtc_code = '{CODE}' AND {RECENT} AND {c}""", CODE, days=DAYS)
both("e14_selected_dtc_weekly_trend", dashboard.selected_dtc_weekly_trend, lambda c: f"""SELECT CAST(date_trunc('week', event_date)::DATE AS VARCHAR) AS week_start,
    sum(occurrence_count)::BIGINT AS occurrences, count(DISTINCT uniqueid) AS affected_vehicles,
    count(*) FILTER (is_resolved = 0) AS active_episodes, count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_episodes
    FROM vfm WHERE dtc_code = '{CODE}' AND event_date >= {TODAY} - 56 AND {c} GROUP BY ALL""", CODE)
_CO = """SELECT o.dtc_code AS {name}, count(*) AS cooccurrence_count, count(DISTINCT o.uniqueid) AS vehicles_affected FROM vfm o
    JOIN (SELECT DISTINCT uniqueid FROM vfm WHERE dtc_code = '{code}' AND {w}) tv ON tv.uniqueid = o.uniqueid
    WHERE o.dtc_code <> '{code}' AND {w} GROUP BY ALL"""
both("e15_selected_dtc_cooccurrence", dashboard.selected_dtc_cooccurrence, lambda c: _CO.format(
        name="co_dtc_code", code=CODE, w=f"{RECENT} AND {c}") + " ORDER BY vehicles_affected DESC, cooccurrence_count DESC, co_dtc_code LIMIT 10",
     CODE, days=DAYS)
both("e16_selected_dtc_vehicles", dashboard.selected_dtc_vehicles, lambda c: f"""SELECT f.uniqueid, min(f.vehicle_number) AS vehicle_number,
    count(*) AS episode_count, count(*) FILTER (f.is_resolved = 0) AS active_episodes, max(f.severity_level) AS max_severity,
    CAST(max(f.event_date) AS VARCHAR) AS last_reported_date, round(max(v.vehicle_health_score), 1)::DOUBLE AS health_score
    FROM vfm f LEFT JOIN vhs v ON v.uniqueid = f.uniqueid WHERE f.dtc_code = '{CODE}' AND f.{RECENT} AND {c.replace('customer_name', 'f.customer_name')}
    GROUP BY f.uniqueid ORDER BY active_episodes DESC, max_severity DESC, episode_count DESC, f.uniqueid LIMIT 100""", CODE, days=DAYS)
both("e17_vehicles_with_dtcs", dashboard.vehicles_with_dtcs, lambda c: f"""SELECT vs.uniqueid, vs.vehicle_number, vs.customer_name,
    array_to_string(list_sort(list_distinct(list(ep.dtc_code))), ',') AS dtc_codes,
    CASE WHEN vs.critical_fault_count > 0 THEN 'Critical' WHEN vs.active_fault_count > 0 THEN 'Active' ELSE 'Normal' END AS status,
    CAST(max(ep.event_date) AS VARCHAR) AS last_reported, vs.active_fault_count AS active_count, vs.critical_fault_count AS critical_count
    FROM vhs vs JOIN vfm ep ON ep.uniqueid = vs.uniqueid AND ep.is_resolved = 0
    WHERE vs.active_fault_count > 0 AND {c.replace('customer_name', 'vs.customer_name')}
    GROUP BY vs.uniqueid, vs.vehicle_number, vs.customer_name, vs.active_fault_count, vs.critical_fault_count
    ORDER BY vs.critical_fault_count DESC, vs.active_fault_count DESC, vs.uniqueid LIMIT 50""")
reg("e18_vehicle_overview", w_(dashboard.vehicle_overview, "V8"), f"""SELECT vs.uniqueid, vs.vehicle_number, coalesce(m.model, '') AS vehicle_model,
    coalesce(m.vehicle_type, '') AS vehicle_type, vs.customer_name, round(vs.vehicle_health_score, 4)::DOUBLE AS health_score,
    vs.active_fault_count, vs.critical_fault_count FROM vhs vs LEFT JOIN vm m ON m.uniqueid = vs.uniqueid WHERE vs.uniqueid = 'V8'""")
V = "V8"
reg("e19_vehicle_faults", w_(dashboard.vehicle_faults, V), f"""SELECT dtc_code, count(*) AS episode_count, count(*) FILTER (is_resolved = 0) AS active_episodes,
    max(severity_level) AS max_severity, max(date_diff('day', event_date, {TODAY})) AS days_persistence FROM vfm
    WHERE uniqueid = '{V}' AND event_date >= {TODAY} - 90 GROUP BY dtc_code""")
reg("e20_vehicle_timeline", w_(dashboard.vehicle_timeline, V, DAYS), f"""SELECT {day()}, count(*) FILTER (is_resolved = 0) AS active_episodes,
    count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_episodes FROM vfm WHERE uniqueid = '{V}' AND {RECENT} GROUP BY vfm.event_date""")
_CUSTOMERS = """SELECT CASE WHEN customer_name = '' THEN 'Unassigned' ELSE customer_name END AS customer_name, count(*) AS vehicle_count,
    count(*) FILTER (active_fault_count > 0) AS active_fault_vehicles, count(*) FILTER (critical_fault_count > 0) AS critical_fault_vehicles,
    avg(vehicle_health_score) AS avg_health_score FROM vhs GROUP BY vhs.customer_name"""
reg("e21_customer_overview", w_(dashboard.customer_overview), f"SELECT * REPLACE ({r4('avg_health_score')}) FROM ({_CUSTOMERS})")
OWN_VEHICLES = f"mp.uniqueid IN (SELECT uniqueid FROM vhs WHERE {CUST})"
_MP = "ORDER BY mp.maintenance_priority_score DESC, mp.uniqueid, mp.dtc_code LIMIT"
_ACTION = "CASE WHEN recommended_action = '' THEN 'Schedule preventive maintenance.' ELSE recommended_action END"
both("e22_maintenance_recommendations", dashboard.maintenance_recommendations, lambda c: f"""SELECT mp.uniqueid, mp.dtc_code, mp.severity_level,
    coalesce(d.subsystem, '') AS subsystem, {_ACTION} AS recommendation FROM maintenance mp LEFT JOIN dm d ON d.dtc_code = mp.dtc_code
    WHERE {c} {_MP} 20""", where=OWN_VEHICLES)
both("e23_fleet_health_snap", dashboard.fleet_health_snap, lambda c: f"""SELECT sum(total_vehicles)::BIGINT AS total_vehicles,
    sum(vehicles_with_active_faults)::BIGINT AS vehicles_with_active_faults, sum(vehicles_with_critical_faults)::BIGINT AS vehicles_with_critical_faults,
    sum(driver_related_faults)::BIGINT AS driver_related_faults,
    round(sum(fleet_health_score * total_vehicles::DOUBLE) / sum(total_vehicles), 2)::DOUBLE AS fleet_health_score,
    coalesce((SELECT most_common_dtc FROM fhs WHERE {c} AND most_common_dtc <> '' ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1), '') AS most_common_dtc,
    coalesce((SELECT most_common_system FROM fhs WHERE {c} AND most_common_system <> '' ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1), '') AS most_common_system,
    (SELECT active_fault_trend FROM fhs WHERE {c} ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1) AS active_fault_trend
    FROM fhs WHERE {c}""", where=OWN_TENANTS)
both("e24_fleet_system_health", dashboard.fleet_system_health, lambda c: f"""SELECT system, sum(vehicles_affected)::BIGINT AS vehicles_affected,
    sum(active_faults)::BIGINT AS active_faults, sum(critical_faults)::BIGINT AS critical_faults, round(avg(risk_score), 2) AS risk_score,
    min(trend) AS trend FROM systems WHERE {c} GROUP BY system""", where=OWN_TENANTS)
both("e25_fleet_fault_trends", dashboard.fleet_fault_trends, lambda c: f"""SELECT {day('date', 'event_date')}, sum(active_faults)::BIGINT AS active_faults,
    sum(new_faults)::BIGINT AS new_faults, sum(resolved_faults)::BIGINT AS resolved_faults, sum(driver_related_faults)::BIGINT AS driver_related_faults,
    round(avg(fleet_health_score), 2) AS fleet_health_score FROM trends WHERE date >= {TODAY} - {DAYS} AND {c} GROUP BY date""",
     where=OWN_TENANTS, days=DAYS)
reg("e26_dtc_fleet_impact", w_(dashboard.dtc_fleet_impact), """SELECT dtc_code, min(system) AS system, min(subsystem) AS subsystem,
    sum(vehicles_affected)::BIGINT AS vehicles_affected, sum(active_vehicles)::BIGINT AS active_vehicles,
    round(avg(avg_resolution_time), 1) AS avg_resolution_time, round(avg(driver_related_ratio), 3) AS driver_related_ratio,
    round(avg(fleet_risk_score), 2) AS fleet_risk_score FROM impact GROUP BY dtc_code ORDER BY fleet_risk_score DESC, dtc_code LIMIT 20""")
reg("e27_dtc_cooccurrence", w_(dashboard.dtc_cooccurrence), """SELECT dtc_code_a, dtc_code_b, sum(cooccurrence_count)::BIGINT AS cooccurrence_count,
    sum(vehicles_affected)::BIGINT AS vehicles_affected, round(avg(avg_time_gap_sec), 1) AS avg_time_gap_sec FROM cooccurrence
    GROUP BY ALL ORDER BY cooccurrence_count DESC, dtc_code_a, dtc_code_b LIMIT 20""")
reg("e28_dtc_detail", w_(dashboard.dtc_detail, CODE), f"""SELECT dtc_code, system, subsystem, description,
    CASE WHEN severity_level = 0 THEN 1 ELSE severity_level END AS severity_level, primary_cause, symptoms, '' AS impact_if_unresolved,
    '' AS fuel_mileage_impact, action_required, '' AS repair_complexity, round(estimated_repair_hours, 4) AS estimated_repair_hours,
    driver_related, '' AS driver_behaviour_category, '' AS recommended_preventive_action FROM dm WHERE dtc_code = '{CODE}'""")
_FLAGS = "has_engine_issue, has_emission_issue, has_safety_issue, has_electrical_issue"
_VHS = f"""SELECT uniqueid, vehicle_number, customer_name, round(vehicle_health_score, 4)::DOUBLE AS vehicle_health_score, active_fault_count,
    critical_fault_count, total_episodes, episodes_last_30_days, round(avg_resolution_time, 1)::DOUBLE AS avg_resolution_time,
    driver_related_faults, most_common_dtc, {_FLAGS} FROM vhs"""
reg("e29_vehicle_health_detail", w_(dashboard.vehicle_health_detail, V), f"{_VHS} WHERE uniqueid = '{V}'")
both("e30_enhanced_maintenance", dashboard.enhanced_maintenance, lambda c: f"""SELECT uniqueid, vehicle_number, dtc_code, description, severity_level,
    fault_duration_sec, episodes_last_30_days, round(maintenance_priority_score, 1)::DOUBLE AS maintenance_priority_score,
    {_ACTION} AS recommended_action FROM maintenance mp WHERE {c} {_MP} 30""", where=OWN_VEHICLES)

# ---------------------------------------------------------------- F. assistant tools
both("f1_fleet_health_totals", tools.fleet_health_totals, lambda c: f"""SELECT count(*) AS total_vehicles,
    count(*) FILTER (active_fault_count > 0) AS vehicles_with_active_faults, count(*) FILTER (critical_fault_count > 0) AS vehicles_with_critical_faults,
    round(avg(vehicle_health_score), 1) AS avg_health_score, sum(active_fault_count)::BIGINT AS total_active_faults,
    sum(critical_fault_count)::BIGINT AS total_critical_faults, sum(driver_related_faults)::BIGINT AS total_driver_related_faults FROM vhs WHERE {c}""")
reg("f1_fleet_health_snapshot", w_(tools.fleet_health_snapshot), """SELECT sum(total_vehicles)::BIGINT AS total_vehicles,
    sum(vehicles_with_active_faults)::BIGINT AS vehicles_with_active_faults, sum(vehicles_with_critical_faults)::BIGINT AS vehicles_with_critical_faults,
    sum(driver_related_faults)::BIGINT AS driver_related_faults,
    round(sum(fleet_health_score * total_vehicles::DOUBLE) / sum(total_vehicles), 2)::DOUBLE AS fleet_health_score,
    coalesce((SELECT most_common_dtc FROM fhs WHERE most_common_dtc <> '' ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1), '') AS most_common_dtc,
    coalesce((SELECT most_common_system FROM fhs WHERE most_common_system <> '' ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1), '') AS most_common_system,
    (SELECT active_fault_trend FROM fhs ORDER BY vehicles_with_active_faults DESC, clientLoginId LIMIT 1) AS active_fault_trend FROM fhs""")
_TOP = "(SELECT {c} FROM (SELECT {c}, sum(occurrence_count) AS s FROM vfm WHERE {w} GROUP BY ALL) ORDER BY s DESC, {c} LIMIT 1)".format
reg("f1_fleet_health_snapshot_customer", w_(tools.fleet_health_snapshot, CUSTOMER), f"""SELECT count(DISTINCT uniqueid) AS total_vehicles,
    count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS vehicles_with_active_faults,
    count(DISTINCT uniqueid) FILTER (is_resolved = 0 AND severity_level >= 3) AS vehicles_with_critical_faults,
    count(*) FILTER (driver_related = 1) AS driver_related_faults, {_TOP(c='dtc_code', w=CUST)} AS most_common_dtc,
    {_TOP(c='system', w=CUST)} AS most_common_system FROM vfm WHERE {CUST}""")
reg("f1_fleet_health_recent_trend", w_(tools.fleet_health_recent_trend), f"""SELECT {day('date')}, round(avg(fleet_health_score), 2) AS fleet_health_score,
    sum(active_faults)::BIGINT AS active_faults, sum(resolved_faults)::BIGINT AS resolved_faults, sum(driver_related_faults)::BIGINT AS driver_related_faults
    FROM trends GROUP BY trends.date ORDER BY trends.date DESC LIMIT 7""")
_DAILY = """SELECT CAST(event_date AS VARCHAR) AS date, count(*) AS active_faults, {}count(*) FILTER (is_resolved = 1) AS resolved_faults,
    count(*) FILTER (driver_related = 1) AS driver_related_faults FROM vfm WHERE {} GROUP BY event_date"""
reg("f1_fleet_health_recent_trend_customer", w_(tools.fleet_health_recent_trend, CUSTOMER, DAYS),
    _DAILY.format("", f"{CUST} AND {RECENT}") + " ORDER BY event_date DESC LIMIT 7")
reg("f2_fleet_dtc_distribution", w_(tools.fleet_dtc_distribution), """SELECT dtc_code, min(description) AS description, min(system) AS system, min(subsystem) AS subsystem,
    min(severity_level) AS severity_level, count(DISTINCT uniqueid) AS vehicles_affected, count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_vehicles,
    sum(occurrence_count)::BIGINT AS total_occurrences, count(*) AS total_episodes,
    round(coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0), 1) AS avg_resolution_time,
    count(*) FILTER (driver_related = 1) AS driver_related_count FROM vfm GROUP BY dtc_code ORDER BY total_occurrences DESC, dtc_code LIMIT 10""")
reg("f2_fleet_dtc_distribution_customer", w_(tools.fleet_dtc_distribution, CUSTOMER, DAYS), f"""SELECT dtc_code, min(description) AS description, min(system) AS system,
    min(subsystem) AS subsystem, min(severity_level) AS severity_level, count(DISTINCT uniqueid) AS vehicles_affected,
    count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_vehicles, sum(occurrence_count)::BIGINT AS total_occurrences, count(*) AS total_episodes,
    round(coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0), 1) AS avg_resolution_time,
    count(*) FILTER (driver_related = 1) AS driver_related_count FROM vfm WHERE {CUST} AND {RECENT} GROUP BY dtc_code
    ORDER BY total_occurrences DESC, dtc_code LIMIT 10""")
reg("f3_fleet_trends", w_(tools.fleet_trends), f"""SELECT {day('date')}, round(sum(fleet_health_score * new_faults) / sum(new_faults), 2)::DOUBLE AS fleet_health_score,
    sum(active_faults)::BIGINT AS active_faults, sum(new_faults)::BIGINT AS new_faults, sum(resolved_faults)::BIGINT AS resolved_faults,
    sum(driver_related_faults)::BIGINT AS driver_related_faults FROM trends GROUP BY trends.date""")
reg("f3_fleet_trends_customer", w_(tools.fleet_trends, CUSTOMER, DAYS), _DAILY.format("count(*) AS new_faults, ", f"{CUST} AND {RECENT}"))
NUM8 = "Customer#000000008"
reg("f4_vehicle_health_status", w_(tools.vehicle_health_status, NUM8), f"{_VHS} WHERE vehicle_number = '{NUM8}'")
reg("f4_vehicle_fault_summary", w_(tools.vehicle_fault_summary, None, V), f"""SELECT dtc_code, system, description, count(*) AS episodes,
    max(severity_level) AS max_severity, count(*) FILTER (is_resolved = 0) AS unresolved, min(first_ts) AS earliest_ts, max(last_ts) AS latest_ts,
    round(avg(resolution_time_sec), 0) AS avg_resolution_sec FROM vfm WHERE uniqueid = '{V}' GROUP BY ALL
    ORDER BY unresolved DESC, episodes DESC, dtc_code LIMIT 15""")
_FAULTS = f"""SELECT episode_id, dtc_code, system, subsystem, description, severity_level, is_resolved, {day()}, first_ts, last_ts,
    occurrence_count, resolution_time_sec, driver_related, round(vehicle_health_score, 4)::DOUBLE AS vehicle_health_score FROM vfm"""
reg("f5_vehicle_faults", w_(tools.vehicle_faults, NUM8), f"""{_FAULTS} WHERE vehicle_number = '{NUM8}'
    ORDER BY vfm.event_date DESC, severity_level DESC, episode_id LIMIT 50""")
reg("f5_vehicle_faults_unresolved", w_(tools.vehicle_faults, None, V, True, DAYS), f"""{_FAULTS} WHERE uniqueid = '{V}' AND is_resolved = 0 AND vfm.{RECENT}
    ORDER BY vfm.event_date DESC, severity_level DESC, episode_id LIMIT 50""")
reg("f6_dtc_details", w_(tools.dtc_details, [" P0003", "P0007 ", "", "P0012"]), """SELECT dtc_code, system, subsystem, description, primary_cause, '' AS secondary_causes,
    symptoms, '' AS impact_if_unresolved, severity_level, '' AS safety_risk_level, action_required, '' AS repair_complexity, '' AS fleet_management_action,
    '' AS recommended_preventive_action, driver_related, '' AS driver_behaviour_category, '' AS driver_behaviour_trigger, 0 AS driver_training_required
    FROM dm WHERE dtc_code IN ('P0003', 'P0007', 'P0012')""")
reg("f7_dtc_cooccurrence", w_(tools.dtc_cooccurrence, CODE), f"""SELECT CASE WHEN dtc_code_a = '{CODE}' THEN dtc_code_b ELSE dtc_code_a END AS cooccurring_dtc,
    cooccurrence_count, vehicles_affected, avg_time_gap_sec FROM cooccurrence WHERE dtc_code_a = '{CODE}' OR dtc_code_b = '{CODE}'
    ORDER BY vehicles_affected DESC, cooccurring_dtc LIMIT 15""")
reg("f7_dtc_cooccurrence_customer", w_(tools.dtc_cooccurrence, CODE, CUSTOMER),
    _CO.format(name="cooccurring_dtc", code=CODE, w=CUST) + " ORDER BY vehicles_affected DESC, cooccurring_dtc LIMIT 15")
both("f8_maintenance_priority", tools.maintenance_priority, lambda c: f"""SELECT mp.vehicle_number, mp.uniqueid, v.customer_name, mp.dtc_code, mp.description,
    mp.severity_level, round(mp.maintenance_priority_score, 4)::DOUBLE AS maintenance_priority_score, mp.fault_duration_sec, mp.episodes_last_30_days,
    mp.recommended_action, round(v.vehicle_health_score, 4)::DOUBLE AS vehicle_health_score, v.active_fault_count, v.critical_fault_count
    FROM maintenance mp LEFT JOIN vhs v ON v.uniqueid = mp.uniqueid WHERE {c} {_MP} 10""")
reg("f9_fleet_system_health", w_(tools.fleet_system_health), f"""SELECT CASE WHEN system IN ('', 'nan') THEN 'other' ELSE system END AS system,
    count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS vehicles_affected, count(*) FILTER (is_resolved = 0) AS active_faults,
    count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_faults,
    round(sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END), 1)::DOUBLE AS risk_score, 'stable' AS trend FROM vfm GROUP BY 1""")
reg("f9_fleet_system_health_customer", w_(tools.fleet_system_health, CUSTOMER), f"""SELECT system, count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS vehicles_affected,
    count(*) FILTER (is_resolved = 0) AS active_faults, count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_faults,
    round(sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END), 1)::DOUBLE AS risk_score FROM vfm WHERE system <> '' AND {CUST} GROUP BY system""")
_IMPACT = """dtc_code, system, subsystem, vehicles_affected, active_vehicles, round(avg_resolution_time, 0)::DOUBLE AS avg_resolution_time,
    round(driver_related_ratio, 3)::DOUBLE AS driver_related_ratio, round(fleet_risk_score, 1)::DOUBLE AS fleet_risk_score"""
_FLEET_IMPACT = f"""SELECT {_IMPACT} FROM (SELECT dtc_code, min(system) AS system, min(subsystem) AS subsystem,
    count(DISTINCT uniqueid) AS vehicles_affected, count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_vehicles,
    coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0) AS avg_resolution_time,
    (count(*) FILTER (driver_related = 1))::DOUBLE / count(*) AS driver_related_ratio,
    sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END) AS fleet_risk_score FROM vfm WHERE {{}} GROUP BY dtc_code) i
    ORDER BY i.fleet_risk_score DESC, dtc_code LIMIT 15"""
reg("f10_dtc_fleet_impact", w_(tools.dtc_fleet_impact), _FLEET_IMPACT.format("true"))
reg("f10_dtc_fleet_impact_customer", w_(tools.dtc_fleet_impact, CUSTOMER), _FLEET_IMPACT.format(CUST))
reg("f11_clamp_limit", lambda s, d: tools.capped(warehouse(s, d).vfm.select("episode_id").orderBy("episode_id"), "9999"),
    "SELECT episode_id FROM vfm ORDER BY episode_id LIMIT 9999")

# ---------------------------------------------------------------- G. front-end roll-ups
reg("g1_customer_totals", w_(frontend.customer_totals), f"""SELECT count(*) AS customers, sum(vehicle_count)::BIGINT AS total_vehicles,
    sum(active_fault_vehicles)::BIGINT AS total_active, sum(critical_fault_vehicles)::BIGINT AS total_critical, round(avg(avg_health_score), 4) AS avg_score
    FROM ({_CUSTOMERS})""")
both("g2_maintenance_buckets", frontend.maintenance_buckets, lambda c: f"""SELECT count(*) FILTER (severity_level >= 3) AS critical,
    count(*) FILTER (severity_level = 2) AS moderate, count(*) FILTER (severity_level <= 1) AS low FROM (SELECT * FROM maintenance mp WHERE {c} {_MP} 30)""",
     where=OWN_VEHICLES)
reg("g3_severity_label", lambda s, d: warehouse(s, d).dm.select(
        "dtc_code", scoring.vehicle_severity_label("severity_level").alias("vehicle_label"),
        scoring.maintenance_severity_label("severity_level").alias("maintenance_label"),
        scoring.code_severity_type("severity_level").alias("code_label")),
    """SELECT dtc_code, (['Minor', 'Minor', 'Moderate', 'High', 'Critical'])[severity_level + 1] AS vehicle_label,
    (['Low', 'Low', 'Moderate', 'High', 'Critical'])[severity_level + 1] AS maintenance_label,
    (['Info', 'Minor', 'Major', 'Critical', 'Critical'])[severity_level + 1] AS code_label FROM dm""")
reg("g4_health_label", lambda s, d: warehouse(s, d).vhs.select("uniqueid", scoring.health_label("vehicle_health_score").alias("label")),
    """SELECT uniqueid, CASE WHEN vehicle_health_score >= 95 THEN 'Excellent' WHEN vehicle_health_score >= 80 THEN 'Good'
    WHEN vehicle_health_score >= 60 THEN 'Fair' ELSE 'Poor' END AS label FROM vhs""")
reg("g5_relative_to_max", lambda s, d: frontend.relative_to_max(warehouse(s, d).distribution.select("clientLoginId", "dtc_code", "total_occurrences"), "total_occurrences"),
    """SELECT clientLoginId, dtc_code, total_occurrences, round(total_occurrences::DOUBLE / greatest(max(total_occurrences) OVER (), 1), 4) AS share_of_max
    FROM distribution""")
_ALIASES = "(SELECT uniqueid AS u, 'vehicle' || row_number() OVER (ORDER BY lower(uniqueid)) AS alias FROM vhs)"
reg("g6_search_vehicles", w_(frontend.search_vehicles, CUSTOMER, "E11"), f"""SELECT uniqueid, vehicle_number FROM vhs JOIN {_ALIASES} ON u = uniqueid
    WHERE {CUST} AND (lower(vehicle_number) LIKE '%e11%' OR alias LIKE '%e11%') ORDER BY vehicle_number, uniqueid LIMIT 20""")
reg("g7_top_active_faults", w_(frontend.top_active_faults, V), f"""SELECT * FROM (SELECT dtc_code, count(*) AS episode_count,
    count(*) FILTER (is_resolved = 0) AS active_episodes, max(severity_level) AS max_severity, max(date_diff('day', event_date, {TODAY})) AS days_persistence
    FROM vfm WHERE uniqueid = '{V}' GROUP BY dtc_code) WHERE active_episodes > 0 ORDER BY active_episodes DESC, max_severity DESC, episode_count DESC, dtc_code LIMIT 5""")
reg("g8_pseudonymise", lambda s, d: frontend.pseudonymise(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_name", "c"),
    "SELECT c_custkey, 'c' || row_number() OVER (ORDER BY lower(c_name)) AS c_name, c_mktsegment FROM customer")


def _masked(s: SparkSession, d: str) -> DataFrame:
    w = warehouse(s, d)
    notes = w.vfm.select("episode_id", F.concat(
        F.lit("Fault "), "dtc_code", F.lit(" on "), F.lower("vehicle_number"), F.lit(" of "), "customer_name").alias("note"))
    return frontend.mask_text(
        notes, "note", frontend.alias_map(w.vhs, "customer_name", "c"),
        frontend.alias_map(w.vhs, "vehicle_number", "vehicle")).select("episode_id", "masked")


reg("g9_mask_text", _masked, """SELECT episode_id, 'Fault ' || dtc_code || ' on ' || v.alias || ' of ' || coalesce(c.alias, '') AS masked FROM vfm
    JOIN (SELECT vehicle_number AS n, 'vehicle' || row_number() OVER (ORDER BY lower(vehicle_number)) AS alias FROM vhs) v ON v.n = vehicle_number
    LEFT JOIN (SELECT customer_name AS n, 'c' || row_number() OVER (ORDER BY lower(customer_name)) AS alias
               FROM (SELECT DISTINCT customer_name FROM vhs WHERE customer_name <> '')) c ON c.n = customer_name""")

# ---------------------------------------------------------------- H. trace tables
def _json_fields(df: DataFrame) -> DataFrame:
    """The JSON columns read back: text of doubles differs between engines."""
    part = lambda c, f: F.get_json_object(c, f"$.{f}")
    return df.withColumns({
        "json_score": part("evaluation_json", "final_score").cast("double"), "json_cause": part("evaluation_json", "root_cause"),
        "json_release": part("version_json", "release_version"), "json_env": part("version_json", "env_name"), "json_commit": part("version_json", "git_commit"),
    }).drop("evaluation_json", "version_json", "prompt_versions_json", "failure_reasons_json")


reg("h1_trace_requests", lambda s, d: _json_fields(tb.stored(s, d, "trace_requests")),
    """SELECT r.rid AS request_id, ts, query, intent, customer_name, 'vehicle' AS mode, x AS response_text, round(final_score, 4) AS final_score,
    round(correctness, 4) AS correctness, round(completeness, 4) AS completeness, round(relevance, 4) AS relevance, round(groundedness, 4) AS groundedness,
    root_cause, judge_mode, t % 3 + 1 AS tools_called_count, t % 8 + 1 AS nodes_executed_count, len(reasons) AS failure_count, len AS tokens_prompt,
    len // 2 AS tokens_completion, release_version, 's1' AS service_version, 'm1' AS model_name, env_name, n AS planner_events_count,
    ok AS planner_success_count, n - ok AS planner_error_count, fixes AS planner_fix_attempts_sum, round(final_score, 4) AS json_score,
    root_cause AS json_cause, release_version AS json_release, env_name AS json_env, 'g' AS json_commit FROM tfinal r JOIN
    (SELECT rid, count(*) AS n, count(*) FILTER (success = 1) AS ok, sum(coalesce(fix, 0))::BIGINT AS fixes FROM tplan GROUP BY rid) USING (rid)""")
reg("h1_trace_requests_json", lambda s, d: tb.stored(s, d, "trace_requests").select("request_id", "failure_reasons_json", "prompt_versions_json"),
    f"""SELECT r.rid AS request_id, CASE WHEN len(reasons) = 0 THEN '[]' ELSE '["' || reasons[1] || '"]' END AS failure_reasons_json,
    '{{' || {" || ',' || ".join(f"'" + '"' + k + '":"v' + f"' || ((c + {i}) % 3) || '" + '"' + "'" for i, k in enumerate(tb.PROMPTS))} || '}}' AS prompt_versions_json FROM tr r""")
reg("h2_trace_nodes", lambda s, d: tb.stored(s, d, "trace_nodes"),
    """SELECT rid AS request_id, ts, p AS pos, node, e_customer AS customer_name, e_mode AS mode, status, round(duration, 4) AS duration_sec, row_count,
    '' AS sql_query, '{"sql_errors_delta":' || sql_errors_delta || ',"tool_called":' || tool_called || ',"intent_is_unknown":' || intent_is_unknown || '}' AS metrics_json,
    CASE WHEN p % 3 = 0 THEN '{"context":{"mode":"fleet"}}' ELSE '{}' END AS input_summary_json, '{}' AS output_summary_json, '[]' AS failure_reasons_json FROM tnode""")
reg("h3_trace_sql_events", lambda s, d: tb.stored(s, d, "trace_sql_events"),
    """SELECT rid AS request_id, ts, q AS pos, 'investigate_data' AS node, tool, customer_name, 'vehicle' AS mode, success, row_count,
    round(duration_sec, 4) AS duration_sec, sql_text AS query, CASE WHEN success = 1 THEN '' ELSE 'boom' END AS error FROM tsql""")
reg("h4_trace_planner_events", lambda s, d: tb.stored(s, d, "trace_planner_events"),
    """SELECT rid AS request_id, ts, 'call_' || q AS tool_call_id, tool, customer_name, 'vehicle' AS mode,
    CASE WHEN q = 0 THEN 'llm_sql_planner' ELSE 'unknown' END AS generated_by, coalesce(fix, 0) AS fix_attempts, success,
    CASE WHEN c % 2 = 0 THEN '["a","b"]' ELSE '[]' END AS selected_tables_json, CASE WHEN c % 2 = 0 THEN 'a,b' ELSE '' END AS selected_tables_csv,
    coalesce(generated_query, '') AS generated_query, coalesce(err, '') AS error,
    '[' || array_to_string(list_transform(range(0, coalesce(fix, 0)), lambda i: '"validator_semantic"'), ',') || ']' AS retry_reasons_json, query FROM tplan""")
reg("h5_trace_node_scores", p_(traces.trace_node_scores),
    "SELECT rid AS request_id, ts, node, customer_name, 'vehicle' AS mode, score FROM tev WHERE score IS NOT NULL")
reg("h6_trace_prompt_scores", p_(traces.trace_prompt_scores),
    """SELECT rid AS request_id, ts, prompt_key, prompt_version, node, customer_name, 'vehicle' AS mode, score AS node_score,
    round(final_score, 4) AS final_score, root_cause, intent, env_name, release_version FROM tpscore""")
reg("h7_trace_prompt_versions", p_(traces.trace_prompt_versions),
    """SELECT rid AS request_id, ts, prompt_key, prompt_version, customer_name, 'vehicle' AS mode, intent, env_name, release_version,
    's1' AS service_version, 'm1' AS model_name, 'g' AS git_commit FROM tprompt""")
reg("h8_prompt_inventory_new", lambda s, d: traces.prompt_inventory_new(
        tb.payloads(s, d), tb.stored(s, d, "trace_prompt_versions").filter("prompt_version = 'v1'").select("prompt_key", "prompt_version")),
    """SELECT DISTINCT prompt_key, prompt_version, 'text of ' || prompt_key || ' ' || prompt_version AS prompt FROM tprompt
    WHERE prompt_version <> 'v1'""")


def _stage_nodes(s: SparkSession, d: str) -> DataFrame:
    e = traces.node_events(tb.payloads(s, d))
    c = F.regexp_extract("request_id", r"R(\d+)-", 1).cast("int")
    return e.select(
        "request_id", "pos", F.col("e.node").alias("node"), "intent",
        F.create_map(F.lit("customer_name"), F.col("customer_name"), F.lit("mode"), F.col("mode")).alias("context"),
        F.array_repeat(F.lit("h"), (c % 3).cast("int")).alias("scope_hints"), F.col("tools_called").alias("tools_used"),
        "tool_results", F.col("sql_events"), F.concat(F.when(c % 2 == 0, "Problem and CAUSE: ").otherwise(""), "text").alias("output_text"))


reg("h9_node_stage_metrics", lambda s, d: traces.node_stage_metrics(_stage_nodes(s, d)).fillna(-1),
    f"""WITH m AS (SELECT e.*, s.n_sql, s.ok_sql, CASE WHEN c % 2 = 0 THEN 'Problem and CAUSE: ' ELSE '' END || x AS body FROM tnode e JOIN
    (SELECT rid, count(*) AS n_sql, sum(success)::BIGINT AS ok_sql FROM tsql GROUP BY rid) s USING (rid))
    SELECT rid AS request_id, p AS pos, node,
    CASE WHEN p = 0 THEN (intent <> '')::INT ELSE -1 END AS intent_valid, CASE WHEN p = 0 THEN 1 ELSE -1 END AS intent_known,
    CASE WHEN p = 0 THEN (intent = 'unknown')::INT ELSE -1 END AS intent_is_unknown,
    CASE WHEN p = 1 THEN c % 3 ELSE -1 END AS scope_hints_count, CASE WHEN p = 1 THEN (customer_name <> '')::INT ELSE -1 END AS has_customer_scope,
    CASE WHEN p = 1 THEN 0 ELSE -1 END AS has_vehicle_scope, CASE WHEN p = 1 THEN 0 ELSE -1 END AS has_dtc_scope, CASE WHEN p = 1 THEN 1 ELSE -1 END AS has_mode_scope,
    CASE WHEN p = 2 THEN 1 ELSE -1 END AS tool_called, CASE WHEN p = 2 THEN n_sql ELSE -1 END AS tool_count, CASE WHEN p = 2 THEN n_sql ELSE -1 END AS tool_results_count,
    CASE WHEN p = 2 THEN n_sql - ok_sql ELSE -1 END AS tool_error_count, CASE WHEN p = 2 THEN round((n_sql - ok_sql)::DOUBLE / n_sql, 3) ELSE -1 END AS tool_error_rate,
    CASE WHEN p = 2 THEN n_sql ELSE -1 END AS sql_query_count, CASE WHEN p = 2 THEN ok_sql ELSE -1 END AS sql_success_count,
    CASE WHEN p IN (3, 4, 5, 6) THEN length(body) ELSE -1 END AS output_chars, CASE WHEN p IN (3, 4, 5, 6) THEN (trim(body) <> '')::INT ELSE -1 END AS output_non_empty,
    CASE WHEN p = 7 THEN length(body) ELSE -1 END AS final_answer_chars, CASE WHEN p = 7 THEN (trim(body) <> '')::INT ELSE -1 END AS final_answer_non_empty,
    {', '.join(f"CASE WHEN p = 7 THEN contains(lower(body), '{k}')::INT ELSE -1 END AS has_{k}_section" for k in ('problem', 'cause', 'impact', 'action'))} FROM m""")
reg("h10_last_metrics_by_node", lambda s, d: traces.last_metrics_by_node(tb.payloads(s, d)).select("request_id", "node", "metrics.*"),
    "SELECT rid AS request_id, node, sql_errors_delta, tool_called, intent_is_unknown FROM tnode")

# ---------------------------------------------------------------- I. observability
FILTERS = {"start_date": PARAMS.days_ago(29), "end_date": PARAMS.days_ago(1), "env_name": "prod", "intent": "All", "prompt_version": "v1"}
_DATE = "make_timestamp(ts * 1000000)::DATE"
_REQ = f"""{_DATE} >= DATE '2024-01-02' AND {_DATE} <= DATE '2024-01-30' AND env_name = 'prod'
    AND EXISTS (SELECT 1 FROM tpscore ps WHERE ps.rid = r.rid AND ps.prompt_version = 'v1')"""


def _obs(fn: Callable, *args) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        return fn(tb.stored(s, d, "trace_requests"), tb.stored(s, d, "trace_prompt_scores"), *args)
    return run


def _cohorts(s: SparkSession, d: str, filters=None) -> DataFrame:
    return observability.prompt_cohorts(tb.stored(s, d, "trace_prompt_scores"), filters)


def _buckets(s: SparkSession, d: str) -> DataFrame:
    return observability.prompt_failure_buckets(tb.stored(s, d, "trace_prompt_scores"))


reg("i1_recent_requests", _obs(observability.recent_requests, FILTERS, 100),
    f"""SELECT rid AS request_id, ts, query, intent, round(final_score, 4) AS final_score, root_cause FROM tfinal r WHERE {_REQ}
    ORDER BY ts DESC, rid LIMIT 100""")
reg("i2_prompt_cohorts", _cohorts, "SELECT prompt_key, prompt_version, round(avg_node_score, 4) AS avg_node_score, round(avg_final_score, 4) AS avg_final_score, runs FROM cohorts")
reg("i3_prompt_failure_buckets", _buckets,
    """SELECT prompt_key, prompt_version, root_cause, runs, round(avg_node_score, 4) AS avg_node_score FROM buckets""")
_DOM = f"""SELECT prompt_key, prompt_version, root_cause AS dominant_root_cause, runs AS root_cause_runs FROM (SELECT *, row_number() OVER
    (PARTITION BY prompt_key, prompt_version ORDER BY runs DESC, root_cause) AS rn FROM buckets) WHERE rn = 1"""
reg("i4_dominant_root_cause", lambda s, d: observability.dominant_root_cause(_buckets(s, d)), _DOM)
reg("i5_prompt_refinement_queue", lambda s, d: observability.prompt_refinement_queue(_cohorts(s, d), _buckets(s, d)),
    f"""SELECT *, CASE WHEN dominant_root_cause IN ('no_tool_data', 'sql_error') THEN '{observability.ADVICE_RETRIEVAL}'
    WHEN dominant_root_cause = 'fault_analysis_empty' THEN '{observability.ADVICE_FAULTS}' WHEN dominant_root_cause = 'explain_empty' THEN '{observability.ADVICE_EMPTY}'
    WHEN prompt_key = 'explain' THEN '{observability.ADVICE_EXPLAIN}' WHEN prompt_key = 'root_cause' THEN '{observability.ADVICE_CAUSE}'
    ELSE '{observability.ADVICE_OTHER}' END AS suggested_refinement FROM (SELECT c.prompt_key, c.prompt_version, round(avg_node_score, 4) AS avg_node_score,
    round(avg_final_score, 4) AS avg_final_score, runs, coalesce(dominant_root_cause, 'unknown') AS dominant_root_cause, coalesce(root_cause_runs, 0) AS root_cause_runs,
    round(0.7 * greatest(0, least(1, 1 - avg_node_score)) + 0.3 * least(runs, 50)::DOUBLE / 50, 3)::DOUBLE AS priority_score
    FROM cohorts c LEFT JOIN ({_DOM}) USING (prompt_key, prompt_version))""")
_V = ["v0", "v1", "v2"]
reg("i6_prompt_score_matrix", lambda s, d: observability.prompt_score_matrix(_cohorts(s, d), _V).withColumn(
        "by_version", F.concat_ws(",", F.map_keys("by_version"))),
    f"SELECT prompt_key, string_agg(prompt_version, ',' ORDER BY prompt_version) AS by_version, {', '.join(f'round(avg(avg_node_score) FILTER (prompt_version = {chr(39)}{v}{chr(39)}), 4) AS {v}' for v in _V)} FROM cohorts GROUP BY prompt_key")
reg("i7_score_trend", _obs(observability.score_trend, FILTERS),
    f"SELECT CAST({_DATE} AS VARCHAR) AS date, round(avg(final_score), 4) AS avg_score, count(*) AS runs FROM tfinal r WHERE {_REQ} GROUP BY ALL")
reg("i8_top_root_causes", _obs(observability.top_root_causes), "SELECT root_cause, count(*) AS runs FROM tr GROUP BY ALL ORDER BY runs DESC, root_cause LIMIT 10")
_CH = "prompt_key, prompt_version, round(avg_node_score, 4) AS avg_node_score, round(avg_final_score, 4) AS avg_final_score, runs"
reg("i9_best_worst_cohorts", lambda s, d: observability.best_worst_cohorts(_cohorts(s, d)),
    f"""SELECT * FROM (SELECT {_CH}, 'worst' AS side FROM cohorts c ORDER BY c.avg_node_score, runs DESC, prompt_key, prompt_version LIMIT 10) UNION ALL
    SELECT * FROM (SELECT {_CH}, 'best' AS side FROM cohorts c ORDER BY c.avg_node_score DESC, runs DESC, prompt_key, prompt_version LIMIT 10)""")
RUNS = ["R1-2", "R3-5", "R5-1"]


def _detail(s: SparkSession, d: str) -> DataFrame:
    out = observability.run_detail(*(tb.stored(s, d, n) for n in ("trace_requests", "trace_nodes", "trace_node_scores")), RUNS)
    return out.select(
        "request_id", "ts", "query", "intent", "text", "evaluation.final_score", "evaluation.root_cause", "nodes_executed",
        F.size("trace_log").alias("nodes"), F.size("evaluation.node_scores").alias("scores"))


reg("i10_run_detail", _detail, f"""SELECT rid AS request_id, ts, query, intent, x AS text, round(final_score, 4) AS final_score, root_cause,
    coalesce(array_to_string(list(node ORDER BY p) FILTER (type = 'node'), ','), '') AS nodes_executed, (count(*) FILTER (type = 'node'))::INT AS nodes, count(score)::INT AS scores
    FROM tev WHERE list_contains({lst(RUNS)}, rid) GROUP BY ALL""")
reg("i11_node_timeline", p_(observability.node_timeline),
    """SELECT rid AS request_id, p AS pos, node, round(duration, 4) AS duration_sec, status, least(p % 3, t % 3 + 1) AS sql_events, row_count,
    CASE WHEN score < 0.6 THEN 'lightcoral' WHEN score < 0.8 THEN 'khaki' WHEN score IS NOT NULL OR status = 'success' THEN 'lightgreen' ELSE 'lightcoral' END AS band FROM tnode""")
reg("i12_trace_root_cause", p_(observability.trace_root_cause),
    """SELECT r.rid AS request_id, coalesce((SELECT node FROM tnode n WHERE n.rid = r.rid AND (sql_errors_delta > 0 OR tool_called = 0 OR intent_is_unknown = 1)
    ORDER BY p LIMIT 1), 'unknown') AS root_cause FROM tr r""")
reg("i13_final_score", lambda s, d: observability.recomputed_final_score(tb.stored(s, d, "trace_requests")),
    "SELECT rid AS request_id, final_score FROM tfinal")
reg("i14_chat_metrics", p_(observability.chat_metrics),
    """SELECT r.rid AS request_id, round(latency_sec, 2) AS latency_sec, t % 3 + 1 AS tools_called, t % 8 + 1 AS nodes_executed_count, len AS tokens_prompt,
    len // 2 AS tokens_completion, len(reasons) AS failure_count, round(ok::DOUBLE / n, 3) AS sql_success_rate FROM tr r JOIN
    (SELECT rid, count(*) AS n, sum(success) AS ok FROM tsql GROUP BY rid) USING (rid)""")
reg("i15_evidence_count", p_(observability.evidence_count),
    """SELECT rid AS request_id, n AS evidence_count, CASE WHEN n = 0 AND intent <> 'casual_conversation' THEN 'insufficient_evidence' ELSE '' END AS failure
    FROM (SELECT rid, intent, count(*) FILTER (err IS NULL AND (data_rows > 0 OR has_section)) AS n FROM ttool GROUP BY ALL)""")

# ---------------------------------------------------------------- J. evaluation


def _scored(s: SparkSession, d: str) -> DataFrame:
    return evaluation.score_questions(tb.eval_questions(s, d), tb.eval_results(s, d))


def _scored_cols(name: str, cols: str, oracle_cols: str | None = None) -> None:
    names = [c.strip() for c in cols.split(",")]
    reg(name, lambda s, d: _scored(s, d).select("id", *names), f"SELECT id, {oracle_cols or cols} FROM scored")


_scored_cols("j1_tool_prf", "tool_recall, tool_precision, tool_f1")
_scored_cols("j2_keyword_hits", "keyword_hits")
_scored_cols("j3_heuristic_scores", "correctness, relevance, completeness, hallucination_risk")
_scored_cols("j4_sql_metrics", "sql_query_count, sql_success_rate, sql_tool_alignment, sql_shape_validity, sql_relevance_score")
reg("j5_node_latency_stats", lambda s, d: _scored(s, d).select(
        "id", "node_events_count", "node_latency_total_sec", "node_latency_avg_sec", "node_latency_max_sec", F.explode("node_latency_by_node").alias("node", "seconds")),
    """SELECT id, node_events_count, node_latency_total_sec, node_latency_avg_sec, node_latency_max_sec, node, round(duration, 3) AS seconds
    FROM scored JOIN tnode ON rid = id""")
_scored_cols("j6_score_questions", """dataset, expected_intent, actual_intent, intent_match, tool_f1, keyword_hits, judge_mode, latency_sec, tokens_prompt,
    tokens_completion, tokens_total, node_events_count, sql_relevance_score""")
_MEANS = {"intent_accuracy": "intent_match", "avg_tool_f1": "tool_f1", "avg_sql_success_rate": "sql_success_rate", "avg_sql_relevance_score": "sql_relevance_score",
          "avg_correctness": "correctness", "avg_completeness": "completeness", "avg_tool_recall": "tool_recall", "avg_tool_precision": "tool_precision",
          "avg_keyword_accuracy": "keyword_hits", "avg_relevance": "relevance", "avg_hallucination_risk": "hallucination_risk",
          "avg_groundedness_score": "round(1 - hallucination_risk, 3)", "avg_hallucination_score": "round(1 - hallucination_risk, 3)"}
_EVAL = f"""count(*) AS questions_evaluated, {', '.join(f'round(avg({e}), 4) AS {n}' for n, e in _MEANS.items())},
    round(avg(latency_sec), 3) AS avg_latency_sec, round(avg(node_latency_avg_sec), 3) AS avg_node_latency_sec, round(avg(node_latency_max_sec), 3) AS avg_node_max_latency_sec,
    sum(tokens_prompt)::BIGINT AS total_tokens_prompt, sum(tokens_completion)::BIGINT AS total_tokens_completion, sum(tokens_total)::BIGINT AS total_tokens_all,
    round(avg(tokens_total), 3) AS avg_tokens_per_question, round(avg(tokens_prompt), 3) AS avg_prompt_tokens_per_question, round(avg(tokens_completion), 3) AS avg_completion_tokens_per_question,
    round((count(*) FILTER (len(reasons) > 0))::DOUBLE / count(*), 4) AS failure_rate, count(*) FILTER (len(reasons) > 0) AS failed_questions_count,
    count(*) FILTER (len(reasons) = 0) AS successful_questions_count,
    round(0.18 * avg(intent_match) + 0.18 * avg(tool_f1) + 0.16 * avg(sql_success_rate) + 0.16 * avg(sql_relevance_score) + 0.14 * avg(correctness)
    + 0.10 * avg(completeness) + 0.08 * avg(round(1 - hallucination_risk, 3)), 4) AS weighted_score, 0::DOUBLE AS llm_judge_ratio,
    round((count(*) FILTER (list_contains(reasons, 'context_length_exceeded')))::DOUBLE / count(*), 4) AS context_length_error_rate,
    round((count(*) FILTER (n_tools > 0))::DOUBLE / count(*), 4) AS tool_usage_rate FROM scored"""
reg("j7_eval_summary", lambda s, d: evaluation.eval_summary(_scored(s, d)), f"SELECT {_EVAL}")
reg("j8_eval_by_dataset", lambda s, d: evaluation.eval_by_dataset(_scored(s, d)),
    f"SELECT coalesce(dataset, 'all') AS dataset, {_EVAL} GROUP BY ROLLUP (dataset)")



def _judged(s: SparkSession, d: str) -> DataFrame:
    """Every second result carries a judge's scores."""
    n = F.length("id") + F.size("tools_called")
    judge = F.struct((n % 5 / 4.0).alias("correctness"), (n % 3 / 2.0).alias("relevance"), (n % 9 / 8.0).alias("completeness"), (n % 7 / 6.0).alias("hallucination_risk"))
    return evaluation.score_questions(tb.eval_questions(s, d), tb.eval_results(s, d).withColumn("judge", F.when(n % 2 == 0, judge)))


_JUDGED = """(SELECT *, n % 2 = 0 AS judged FROM (SELECT s.*, length(s.id) + t % 3 + 1 AS n FROM scored s JOIN tr ON rid = s.id))"""
_BY = "round(CASE WHEN judged THEN (n % {})::DOUBLE / {} ELSE {} END, 3)".format
reg("j6_judged_scores", lambda s, d: _judged(s, d).select("id", "judge_mode", "correctness", "relevance", "completeness", "hallucination_risk"),
    f"""SELECT id, CASE WHEN judged THEN 'llm' ELSE 'heuristic' END AS judge_mode, {_BY(5, 4, 'correctness')} AS correctness, {_BY(3, 2, 'relevance')} AS relevance,
    {_BY(9, 8, 'completeness')} AS completeness, {_BY(7, 6, 'hallucination_risk')} AS hallucination_risk FROM {_JUDGED}""")
reg("j7_eval_summary_judged", lambda s, d: evaluation.eval_summary(_judged(s, d)).select("questions_evaluated", "llm_judge_ratio", "avg_correctness", "avg_hallucination_risk"),
    f"""SELECT count(*) AS questions_evaluated, round((count(*) FILTER (judged))::DOUBLE / count(*), 4) AS llm_judge_ratio,
    round(avg({_BY(5, 4, 'correctness')}), 4) AS avg_correctness, round(avg({_BY(7, 6, 'hallucination_risk')}), 4) AS avg_hallucination_risk FROM {_JUDGED}""")

# ---------------------------------------------------------------- K. conversations
reg("k1_recent_messages", lambda s, d: conversations.recent_messages(tb.messages(s, d), 3).drop("ts"),
    "SELECT conversation_id, message_index, role, content FROM msg WHERE rn <= 3")
reg("k2_next_message_index", lambda s, d: conversations.next_message_index(tb.messages(s, d)),
    "SELECT conversation_id, max(message_index) + 1 AS next_index FROM msg GROUP BY ALL")


def _assigned(s: SparkSession, d: str) -> DataFrame:
    m = tb.messages(s, d)
    # every seventh message has lost its time
    batch = m.withColumn("seq", F.col("message_index")).drop("message_index").withColumn("ts", F.when(F.col("seq") % 7 != 3, F.col("ts")))
    return conversations.assign_indexes(m.filter("message_index < 2"), batch).select("conversation_id", "seq", "message_index")


reg("k2_assign_indexes", _assigned,
    """SELECT conversation_id, message_index AS seq, coalesce(mx + 1, 0) + row_number() OVER
    (PARTITION BY conversation_id ORDER BY message_index % 7 <> 3, message_index) - 1 AS message_index FROM msg LEFT JOIN (SELECT conversation_id, max(message_index) AS mx FROM msg WHERE message_index < 2 GROUP BY ALL) USING (conversation_id)""")
reg("k3_latest_conversation", lambda s, d: conversations.latest_conversation(tb.conversations(s, d)).select(
        "conversation_id", "customer_name", "created_ts", F.coalesce(F.try_element_at("context", F.lit("mode")), F.lit("")).alias("context_mode")),
    """SELECT conversation_id, customer_name, created_ts, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'm' || (conv_id % 3) END AS context_mode FROM
    (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_ts DESC) AS rn FROM conv) WHERE rn = 1""")
reg("k4_new_conversations", lambda s, d: conversations.new_conversations(tb.chat_requests(s, d), tb.conversations(s, d)),
    """SELECT conversation_id, customer_name, mode, created_ts, '{}' AS context_json FROM (SELECT *, row_number() OVER
    (PARTITION BY conversation_id ORDER BY created_ts) AS rn FROM creq) WHERE rn = 1 AND conversation_id NOT IN (SELECT conversation_id FROM conv)""")
reg("k5_scope_violations", lambda s, d: conversations.scope_violations(tb.chat_requests(s, d), tb.conversations(s, d)).select(
        "conversation_id", "turn", "customer_name"),
    """SELECT r.conversation_id, r.turn, r.customer_name FROM creq r JOIN (SELECT *, row_number() OVER
    (PARTITION BY conversation_id ORDER BY created_ts DESC) AS rn FROM conv) o ON o.conversation_id = r.conversation_id AND o.rn = 1
    WHERE lower(trim(o.customer_name)) <> lower(trim(r.customer_name))""")


def _contexts(s: SparkSession, d: str) -> DataFrame:
    m = tb.messages(s, d)
    last = m.groupBy("conversation_id").agg(F.max_by("content", "message_index").alias("query_text"))
    # every second conversation repeats its last message, the others ask anew
    asks = last.withColumn("query_text", F.when(F.col("conversation_id").cast("int") % 2 == 0, F.col("query_text")).otherwise("next?"))
    return conversations.context_window(m, asks, 4)


reg("k6_context_window", _contexts,
    """WITH kept AS (SELECT conversation_id, message_index AS position, role, content FROM msg WHERE rn <= 4 AND role IN ('user', 'assistant')),
    last AS (SELECT conversation_id, max(position) AS p, arg_max(role, position) AS r, arg_max(content, position) AS m FROM kept GROUP BY ALL),
    asks AS (SELECT conversation_id, CASE WHEN conversation_id::INT % 2 = 0 THEN content ELSE 'next?' END AS qt FROM msg WHERE rn = 1)
    SELECT * FROM kept UNION ALL SELECT a.conversation_id, coalesce(p + 1, 0) AS position, 'user' AS role, qt AS content FROM asks a LEFT JOIN last l USING (conversation_id)
    WHERE NOT coalesce(r = 'user' AND m = qt, FALSE)""")

# ---------------------------------------------------------------- L. audits


def _log(s: SparkSession, d: str) -> DataFrame:
    return tb.stored(s, d, "trace_sql_events")


_LOG = "rid AS request_id, q AS pos"
# query texts made from the columns of ``orders``; this part is valid in both dialects
_NAME = """CASE {} % 6 WHEN 0 THEN 'vehicle_fault_master' WHEN 1 THEN 'fleet_health_summary' WHEN 2 THEN 'dtc_master'
    WHEN 3 THEN 'other_table' WHEN 4 THEN 'users' ELSE 'maintenance_priority' END""".format
_QUOTED = """CASE o_orderkey % 5 WHEN 0 THEN '`' || {0} || '`' WHEN 1 THEN 'db.' || {0} WHEN 2 THEN upper({0}) WHEN 3 THEN '"db"."' || {0} || '"' ELSE {0} END""".format
_COLS = """CASE o_orderkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'count(*)' WHEN 2 THEN 'system, count(*) AS n' WHEN 3 THEN 'uniqueid, dtc_code'
    WHEN 4 THEN 'SUM (x), max(y)' WHEN 5 THEN 'lower(system), topk(3)(dtc_code)' ELSE 'DISTINCT customer_name' END"""
_QUERY = f"""CASE o_custkey % 13 WHEN 0 THEN 'DROP TABLE ' WHEN 1 THEN '  (select ' WHEN 2 THEN 'with t as (select 1) SELECT ' WHEN 3 THEN 'EXPLAIN SELECT '
    WHEN 4 THEN 'Select /* no delete here */ ' ELSE 'SELECT ' END || {_COLS} || CASE o_orderkey % 3 WHEN 0 THEN ' from ' ELSE ' FROM ' END || {_QUOTED(_NAME('o_custkey'))}
    || CASE WHEN o_orderkey % 2 = 0 THEN ' a LEFT JOIN ' || {_QUOTED(_NAME('o_orderkey'))} || ' b ON a.x = b.x' ELSE '' END
    || ' WHERE status = ' || o_orderstatus || CASE o_custkey % 4 WHEN 0 THEN ' GROUP BY system' WHEN 1 THEN ' LIMIT 9' ELSE '' END"""


def _queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_QUERY).alias("query"))


_TEXTS = f"(SELECT o_orderkey AS id, {_QUERY} AS query, lower({_QUERY}) AS low FROM orders)"
_AGGS = "|".join(audits.AGGREGATES)
reg("l1_audit_readonly", lambda s, d: audits.audit_readonly(_queries(s, d)).select("id", "readonly_finding").fillna(""),
    f"""SELECT id, CASE WHEN NOT regexp_matches(ltrim(low), '^[(]*(select|with)') THEN 'not_a_select'
    WHEN len(list_intersect(regexp_split_to_array(low, '[^a-z0-9_]+'), {lst([w.lower() for w in audits.FORBIDDEN])})) > 0 THEN 'forbidden_keyword' ELSE '' END AS readonly_finding FROM {_TEXTS}""")
reg("l2_audit_tables", lambda s, d: audits.audit_tables(_queries(s, d)).select("id", F.array_join(F.array_sort("disallowed_tables"), ",").alias("disallowed_tables")),
    f"""SELECT id, coalesce(list_aggregate(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(low, '(from|join) +([^ ]+)', 2),
    lambda n: replace(replace(list_last(string_split(n, '.')), '`', ''), '"', '')), lambda n: NOT list_contains({lst(audits.ALLOWED_TABLES)}, n)))), 'string_agg', ','), '') AS disallowed_tables FROM {_TEXTS}""")


def _scoped_log(s: SparkSession, d: str) -> DataFrame:
    n = F.col("pos")
    return _log(s, d).withColumns({
        "vehicle_number": F.when(n == 2, "KA-1").otherwise(""), "uniqueid": F.lit(""), "dtc_code": F.when(n == 1, "P0001").otherwise("")})


reg("l3_audit_scope", lambda s, d: audits.audit_scope(_scoped_log(s, d)).select("request_id", "pos", "scope_finding").fillna(""),
    f"""SELECT {_LOG}, CASE WHEN customer_name <> '' AND lower(sql_text) NOT LIKE '%customer_name%' THEN 'customer_filter_missing'
    WHEN customer_name <> '' AND NOT contains(lower(sql_text), '''' || customer_name || '''') THEN 'customer_mismatch'
    WHEN q = 2 THEN 'vehicle_scope_missing' WHEN q = 1 THEN 'dtc_scope_missing' ELSE '' END AS scope_finding FROM tsql""")
reg("l4_audit_shape", lambda s, d: audits.audit_shape(_queries(s, d)).select("id", "raw_fact_scan", "select_star", "ungrouped_columns"),
    f"""SELECT id, (contains(low, 'vehicle_fault_master') AND NOT grouped AND NOT contains(low, 'limit'))::INT AS raw_fact_scan, contains(low, 'select *')::INT AS select_star,
    (NOT grouped AND regexp_matches(low, '({_AGGS})[(]') AND len(list_filter(string_split(cols, ','), lambda c: trim(c) <> '' AND NOT regexp_matches(c, '(^|[^a-z0-9_])({_AGGS}) *[(]'))) > 0)::INT AS ungrouped_columns
    FROM (SELECT *, contains(low, 'group by') AS grouped, CASE WHEN contains(low, 'select') THEN substr(split_part(low, ' from ', 1), strpos(low, 'select') + 6)
          ELSE split_part(low, ' from ', 1) END AS cols FROM {_TEXTS})""")
reg("l5_audit_result", lambda s, d: audits.audit_result(_log(s, d).withColumn("first_row", F.create_map(
        F.lit("note"), F.when(F.col("pos") % 2 == 0, " "), F.lit("n"), F.when(F.col("row_count") > 2, F.col("row_count").cast("string"))))),
    """SELECT tool, count(*) AS executions, count(*) FILTER (success = 0) AS failed, count(*) FILTER (success = 1 AND row_count = 0) AS empty,
    count(*) FILTER (success = 1 AND row_count BETWEEN 1 AND 2) AS blank_first_row FROM tsql GROUP BY tool""")


def _catalogue_sql(k: int) -> str:
    from faultloom.functions.catalogue import CATALOGUE

    rows = []
    for e in CATALOGUE:
        terms = [*e.use_cases, *[w for w in e.description.lower().split() if len(w) > 4], *e.columns]
        rows.append(f"('{e.table}', {lst([t.lower() for t in terms])}, {int(e.priority == 'aggregated')})")
    asked = "lower(text) || ' ' || tool"
    return f"""SELECT doc_id, rank, table_name, score FROM (SELECT doc_id, table_name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_name) AS rank FROM
    (SELECT doc_id, table_name, len(list_filter(terms, lambda x: contains({asked}, x))) + bonus
     + contains({asked}, replace(replace(tool, 'get_', ''), '_', ' '))::INT AS score
     FROM (SELECT *, (['get_fleet_health', 'get_dtc_details'])[doc_id % 2 + 1] AS tool FROM documents), (VALUES {', '.join(rows)}) v(table_name, terms, bonus)) WHERE score > 0) WHERE rank <= {k}"""


reg("l6_relevant_tables", lambda s, d: audits.relevant_tables(
        table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "get_fleet_health").otherwise("get_dtc_details").alias("tool")),
        4, question="text", tool="tool").select("doc_id", "rank", "table_name", "score"), _catalogue_sql(4))
reg("l7_planner_retry_stats", lambda s, d: audits.planner_retry_stats(
        tb.payloads(s, d).select(F.explode("planner_events").alias("e")).select("e.*")),
    """SELECT tool, count(*) AS runs, sum(coalesce(fix, 0))::BIGINT AS fix_attempts, count(*) FILTER (success = 1) AS succeeded,
    CASE WHEN sum(coalesce(fix, 0)) > 0 THEN 'validator_semantic' ELSE '' END AS reason, sum(coalesce(fix, 0))::BIGINT AS times FROM tplan GROUP BY tool""")
