"""Trace runs, chat tables and evaluation rows derived from ``conversations``
and ``labels``: every turn is one assistant run (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.functions.scoring import final_score
from faultloom.operators.traces import NODE_TO_PROMPT, planner_events
from faultloom.plans.trace_store import TraceStore
from faultloom.session import run_folder
from faultloom.sources.readers import read_trace_runs
from testbed.inputs import table

NODES = ("detect_intent", "build_context", "investigate_data", "analyze_faults", "reason_root_cause",
         "assess_maintenance", "generate_recommendation", "explain")
INTENTS = ("vehicle_investigation", "fleet_health", "unknown", "casual_conversation", "")
CAUSES = ("unknown", "no_tool_data", "sql_error", "explain_empty", "fault_analysis_empty")
TOOLS = ("get_fleet_health", "get_vehicle_health", "get_dtc_details", "run_sql")
QUERIES = (
    "SELECT dtc_code, count(*) FROM vehicle_fault_master",
    "SELECT * FROM db.fleet_health_summary LIMIT 5",
    "with t as (select 1) SELECT uniqueid FROM `vehicle_health_summary` WHERE customer_name = 'pc1' LIMIT 3",
    "DROP TABLE users",
    "SELECT a.system, sum(a.active_faults) FROM fleet_system_health a JOIN other_table b ON a.system = b.system "
    "GROUP BY a.system",
    "EXPLAIN SELECT 1",
)
DATASETS = ("fleet", "vehicle", "dtc")
KEYWORDS = ("la", "que", "the", "und", "de")
PROMPTS = tuple(NODE_TO_PROMPT.values())

def _ids() -> tuple[F.Column, F.Column]:
    """Conversation and turn number."""
    return F.col("c"), F.col("t")


def _pick(words, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("int").alias("c"), F.col("turn").cast("int").alias("t"), "role", F.col("text").alias("x"),
        F.length("text").alias("len"))


def _sql_event(q) -> F.Column:
    c, t = _ids()
    ok = (c + t + q) % 4 != 0
    return F.struct(
        F.lit("investigate_data").alias("node"), _pick(TOOLS, c + q).alias("tool"), _pick(QUERIES, c + q).alias("query"),
        ok.alias("success"), ((c * q + t) % 5).cast("long").alias("row_count"), ((q + 1) / 10.0).alias("duration_sec"),
        F.when(ok, "").otherwise("boom").alias("error"))


def _node_event(p) -> F.Column:
    c, t = _ids()
    strings = F.lit(None).cast("map<string,string>")
    return F.struct(
        F.when((c + p) % 7 == 0, "sql").otherwise("node").alias("type"), _pick(NODES, p).alias("node"),
        F.when(p % 2 == 0, F.concat(F.lit("cust"), (c % 4).cast("string"))).alias("customer_name"),
        F.when((c + p) % 5 == 0, "error").otherwise("success").alias("status"),
        ((F.col("len") % 100 + p) / 100.0).alias("duration"), (t + p).cast("long").alias("row_count"),
        F.lit(None).cast("string").alias("sql_query"),
        F.struct(
            ((c + t + p) % 9 == 0).cast("int").alias("sql_errors_delta"),
            ((c + p) % 6 != 0).cast("int").alias("tool_called"),
            ((p == 0) & ((c + t) % 5 == 2)).cast("int").alias("intent_is_unknown")).alias("metrics"),
        F.when(p % 3 == 0, F.struct(F.create_map(F.lit("mode"), F.lit("fleet")).alias("context"))).alias("input_summary"),
        strings.alias("output_summary"),
        F.array().cast("array<string>").alias("failure_reasons"),
        F.slice(F.col("run_sql"), F.lit(1), (p % 3).cast("int")).alias("sql_events"))


def _tool_result(q) -> F.Column:
    c, t = _ids()
    fix = F.when(q < 2, (c + q) % 4)
    return F.struct(
        _pick(TOOLS, c + q).alias("tool"), F.when(q == 0, "llm_sql_planner").alias("generated_by"),
        F.when((c + q) % 2 == 0, _pick(QUERIES, c + q)).alias("generated_query"), fix.cast("int").alias("fix_attempts"),
        F.when(c % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("selected_tables"),
        F.when((c + t + q) % 4 == 0, "bad").alias("error"),
        F.array_repeat(F.lit("validator_semantic"), F.coalesce(fix, F.lit(0)).cast("int")).alias("retry_reasons"),
        ((c + q) % 3).cast("long").alias("data_rows"),
        F.array(F.when((c + q) % 5 == 0, "summary").otherwise("other")).alias("sections"))


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records in the nested source form, plus the payload's side columns."""
    c, t = _ids()
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("c"), "quality", "toxic")
    rows = turns(spark, sf_dir).join(labels, "c", "left")
    upto = lambda n, fn: F.transform(F.sequence(F.lit(0), n), fn)
    rows = rows.withColumn("run_sql", upto(t % 3, _sql_event))
    quality, sound = F.coalesce(F.col("quality") * 1.0, F.lit(0.5)), F.coalesce(1.0 - F.col("toxic"), F.lit(0.5))
    scores = {"correctness": quality, "completeness": quality * 0.5 + 0.25, "relevance": 0.5 + (t % 4) / 10.0,
              "groundedness": sound}
    node_scores = F.map_from_entries(upto(t % 8, lambda p: F.struct(
        _pick(NODES, p), F.when((c + p) % 11 == 0, "bad").otherwise(
            ((c * 7 + p * 13 + t) % 100 / 100.0).cast("string")))))
    version_of = [(F.lit(k), F.concat(F.lit("v"), ((c + i) % 3).cast("string"))) for i, k in enumerate(PROMPTS)]
    run_id = F.concat(F.lit("R"), c.cast("string"), F.lit("-"), t.cast("string"))
    reasons = F.when((c + t) % 10 == 0, F.array(F.lit("context_length_exceeded"))).when(
        (c + t) % 10 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        run_id.alias("id"), F.timestamp_seconds(F.lit(1704067200) + c * 3600 + t * 60).alias("start_time"),
        F.struct(F.concat(F.lit("in: "), "role").alias("query")).alias("inputs"),
        F.struct(
            F.when(t % 4 != 1, F.col("x")).otherwise("").alias("text"),
            F.array(F.struct(F.lit("first").alias("content")), F.struct(F.col("x").alias("content"))).alias("messages"),
            _pick(INTENTS, c + t).alias("intent"), upto(t % 8, _node_event).alias("trace_log"),
            F.struct(
                final_score(scores["correctness"], scores["groundedness"], scores["relevance"],
                            scores["completeness"]).alias("final_score"),
                *[v.alias(k) for k, v in scores.items()], _pick(CAUSES, c + t).alias("root_cause"),
                F.when(c % 2 == 0, "llm").otherwise("heuristic").alias("judge_mode"),
                node_scores.alias("node_scores")).alias("evaluation"),
            upto(t % 8, lambda p: _pick(NODES, p)).alias("nodes_executed"),
            F.struct(
                F.concat(F.lit("r"), (c % 2).cast("string")).alias("release_version"), F.lit("s1").alias("service_version"),
                F.lit("m1").alias("model_name"), F.when(c % 3 == 0, "dev").otherwise("prod").alias("env_name"),
                F.lit("g").alias("git_commit"),
                F.create_map(*[x for kv in version_of for x in kv]).alias("prompt_versions"),
                F.create_map(*[x for k, v in version_of for x in (k, F.concat(F.lit("text of "), k, F.lit(" "), v))])
                .alias("prompt_catalog")).alias("version"),
            upto(t % 3, lambda q: _pick(TOOLS, c + q)).alias("tools_called"), F.col("run_sql").alias("sql_events"),
            F.struct(F.col("len").cast("long").alias("prompt"), F.floor(F.col("len") / 2).alias("completion"))
            .alias("token_usage"), reasons.alias("failure_reasons")).alias("outputs"),
        F.struct(F.struct(
            F.when(c % 3 != 0, run_id).otherwise("").alias("request_id"),
            F.when(t % 2 == 0, F.concat(F.lit("q: "), "role")).alias("query"), F.lit("fleet_health").alias("intent"),
            F.when(c % 3 == 0, "dev").otherwise("prod").alias("env_name"),
            F.concat(F.lit("r"), (c % 2).cast("string")).alias("release_version")).alias("metadata")).alias("extra"),
        F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("pc"), (c % 3).cast("string"))).alias("customer_name"),
        F.lit("vehicle").alias("mode"),
        F.map_from_entries(upto(t % 3, lambda q: F.struct(
            F.concat(F.lit("call_"), q.cast("string")), _tool_result(q)))).alias("tool_results"),
        (F.col("len") % 50 / 10.0).alias("latency_sec"), "c", "t", "role", "x")


def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as lines of JSON: some with a score that is no number, some with
    a field more, some cut off, some that are no objects."""
    c, t = _ids()
    runs = trace_runs(spark, sf_dir)
    whole = F.to_json(F.struct("id", "start_time", "inputs", "outputs", "extra"))
    drifted = F.when(t % 5 == 1, F.regexp_replace(whole, r'"final_score":[0-9.E-]+', '"final_score":"high"')).otherwise(whole)
    wider = F.when(t % 3 == 0, F.concat(F.lit('{"cost":7,'), F.substr(drifted, F.lit(2)))).otherwise(drifted)
    return runs.select(
        F.when(c % 13 == 0, F.substr(wider, F.lit(1), F.length(wider) - 5)).when(c % 13 == 1, F.concat(F.lit("["), wider, F.lit("]")))
        .otherwise(wider).alias("value"))


def question_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of question files, each a JSON array of the questions of 50 conversations in order."""
    folder = f"{run_folder(spark)}/questions"
    asked = eval_questions(spark, sf_dir).withColumn("file", F.floor(F.col("position") / 5000))
    item = F.to_json(F.struct("id", "question", "expected_intent", "expected_tools", "expected_output_contains"))
    inside = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))["item"]
    files = asked.groupBy("file").agg(F.concat(F.lit("["), F.array_join(inside, ","), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened run payloads with the service's side columns, as stored."""
    return store(spark, sf_dir).payloads().drop("batch", "event_date")


_stores: dict[tuple[str, str], TraceStore] = {}


def store(spark: SparkSession, sf_dir: str) -> TraceStore:
    """One trace store per application and input folder, filled in two appends
    of which the second repeats half of the first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        runs = trace_runs(spark, sf_dir)
        flat = planner_events(read_trace_runs(runs, ("customer_name", "mode", "tool_results", "latency_sec", "c")))
        made = TraceStore(spark, f"{run_folder(spark)}/traces")
        made.append(flat.filter("c % 2 = 0").drop("c"), "first")
        made.append(flat.filter("c % 4 > 0").drop("c"), "second")
        _stores[key] = made
    return _stores[key]


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store(spark, sf_dir).table(name).drop("batch", "event_date")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("message_index"),
        "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions of every conversation: one row per turn."""
    c, t = _ids()
    return turns(spark, sf_dir).select(
        c.cast("string").alias("conversation_id"),
        F.concat(F.lit(" Fleet"), ((c + t) % 4).cast("string"), F.lit(" ")).alias("customer_name"),
        F.lit("general").alias("mode"), F.timestamp_seconds(F.lit(1704067200) + c * 3600 + t * 60).alias("created_ts"),
        F.when(c % 5 == 0, "not json").otherwise(
            F.concat(F.lit('{"mode":"m'), (c % 3).cast("string"), F.lit('"}'))).alias("context_json"))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per turn, some of them for conversations not stored yet."""
    c, t = _ids()
    return turns(spark, sf_dir).select(
        F.concat(F.when(c % 4 == 0, "new-").otherwise(""), c.cast("string")).alias("conversation_id"),
        F.concat(F.lit("fleet"), (c % 3).cast("string")).alias("customer_name"),
        F.when(t % 2 == 0, " fleet ").alias("mode"),
        F.timestamp_seconds(F.lit(1704067200) + c * 3600 + t * 60).alias("created_ts"),
        F.lit("{}").alias("context_json"), t.alias("turn"), F.col("x").alias("query_text"))


def eval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _ids()
    return turns(spark, sf_dir).select(
        F.concat(F.lit("R"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id"),
        _pick(DATASETS, c).alias("dataset"), (c * 100 + t).alias("position"), F.col("x").alias("question"),
        _pick(INTENTS[:4], c).alias("expected_intent"),
        F.when(c % 6 == 0, F.array().cast("array<string>")).otherwise(
            F.array(_pick(TOOLS, c), _pick(TOOLS, c + t))).alias("expected_tools"),
        F.slice(F.array(*[F.lit(k) for k in KEYWORDS]), F.lit(1), (t % 5).cast("int")).alias("expected_output_contains"))


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select(
        F.col("request_id").alias("id"), "text", "intent", "tools_called", "sql_events", "trace_log", "token_usage",
        "failure_reasons", "latency_sec")
