"""Analyses of the flattened trace tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import final_score as final_score_of, settle
from faultloom.operators.traces import EVIDENCE_SECTIONS, node_events

REQUEST_FILTERS = ("intent", "root_cause", "env_name", "release_version")
PROMPT_FILTERS = ("prompt_key", "prompt_version")


def _apply(df: DataFrame, filters: Mapping | None, names) -> DataFrame:
    filters = filters or {}
    if filters.get("start_date") is not None:
        df = df.filter(F.to_date("ts") >= F.lit(filters["start_date"]))
    if filters.get("end_date") is not None:
        df = df.filter(F.to_date("ts") <= F.lit(filters["end_date"]))
    for name in names:
        if filters.get(name) not in (None, "", "All"):
            df = df.filter(F.col(name) == filters[name])
    return df


def filtered_requests(requests: DataFrame, prompt_scores: DataFrame, filters: Mapping | None = None) -> DataFrame:
    rows = _apply(requests, filters, REQUEST_FILTERS)
    wanted = {k: v for k, v in (filters or {}).items() if k in PROMPT_FILTERS and v not in (None, "", "All")}
    if wanted:
        rows = rows.join(_apply(prompt_scores, wanted, PROMPT_FILTERS).select("request_id"), "request_id", "left_semi")
    return rows


def filtered_prompts(prompt_scores: DataFrame, filters: Mapping | None = None) -> DataFrame:
    return _apply(prompt_scores, filters, REQUEST_FILTERS + PROMPT_FILTERS)


def recent_requests(requests: DataFrame, prompt_scores: DataFrame, filters: Mapping | None = None, limit: int = 200) -> DataFrame:
    return filtered_requests(requests, prompt_scores, filters).orderBy(F.desc("ts"), "request_id").limit(int(limit)).select(
        "request_id", "ts", "query", "intent", "final_score", "root_cause")


def prompt_cohorts(prompt_scores: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """All cohorts of three runs or more, the weakest first; ``limit`` the result to show some of them."""
    return filtered_prompts(prompt_scores, filters).groupBy("prompt_key", "prompt_version").agg(
        F.avg("node_score").alias("avg_node_score"), F.avg("final_score").alias("avg_final_score"),
        F.count("*").alias("runs")).filter("runs >= 3").orderBy(
        "avg_node_score", F.desc("runs"), "prompt_key", "prompt_version")


def prompt_failure_buckets(prompt_scores: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """All buckets of weak runs, the largest first; ``limit`` the result to show some of them."""
    return filtered_prompts(prompt_scores, filters).filter("node_score < 0.7").groupBy(
        "prompt_key", "prompt_version", "root_cause").agg(
        F.count("*").alias("runs"), F.avg("node_score").alias("avg_node_score")).orderBy(
        F.desc("runs"), "prompt_key", "prompt_version", "root_cause")


def dominant_root_cause(buckets: DataFrame) -> DataFrame:
    """Most frequent cause per prompt and version, ties to the smallest cause."""
    rank = F.struct(-F.col("runs"), F.col("root_cause"))
    return buckets.groupBy("prompt_key", "prompt_version").agg(
        F.min_by(F.struct("root_cause", "runs"), rank).alias("b")).select(
        "prompt_key", "prompt_version", F.col("b.root_cause").alias("dominant_root_cause"),
        F.col("b.runs").alias("root_cause_runs"))


# fixed values: advice per finding
ADVICE_RETRIEVAL = (
    "Tighten investigate prompt: require minimum tool coverage and explicit customer-scoped retrieval before fallback.")
ADVICE_FAULTS = (
    "Strengthen fault analysis prompt with required sections: system grouping, severity split, and top-3 "
    "evidence-backed findings.")
ADVICE_EMPTY = (
    "Strengthen explain prompt with mandatory response template and non-empty completion constraints.")
ADVICE_EXPLAIN = (
    "Add few-shot examples for concise but complete manager-facing explanations with explicit next actions.")
ADVICE_CAUSE = (
    "Increase co-occurrence reasoning constraints and require ranked hypotheses with confidence and mechanism.")
ADVICE_OTHER = (
    "Refine prompt instructions with stricter output schema and at least one high-quality example for this node.")


def _advice(prompt_key: str, root_cause: str):
    cause, key = F.lower(F.coalesce(F.col(root_cause), F.lit(""))), F.col(prompt_key)
    return (
        F.when(cause.contains("no_tool_data") | cause.contains("sql_error"), ADVICE_RETRIEVAL)
        .when(cause.contains("fault_analysis_empty"), ADVICE_FAULTS)
        .when(cause.contains("explain_empty"), ADVICE_EMPTY)
        .when(key == "explain", ADVICE_EXPLAIN).when(key == "root_cause", ADVICE_CAUSE).otherwise(ADVICE_OTHER)
    )


def prompt_refinement_queue(cohorts: DataFrame, buckets: DataFrame) -> DataFrame:
    joined = cohorts.join(dominant_root_cause(buckets), ["prompt_key", "prompt_version"], "left").withColumns({
        "dominant_root_cause": F.coalesce("dominant_root_cause", F.lit("unknown")),
        "root_cause_runs": F.coalesce("root_cause_runs", F.lit(0)),
    })
    need = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("avg_node_score")))
    weight = F.least(F.col("runs").cast("double"), F.lit(50.0)) / 50.0
    return joined.select(
        "prompt_key", "prompt_version", "avg_node_score", "avg_final_score", "runs", "dominant_root_cause",
        "root_cause_runs", settle(0.7 * need + 0.3 * weight, 3).alias("priority_score"),
        _advice("prompt_key", "dominant_root_cause").alias("suggested_refinement"),
    ).orderBy(F.desc("priority_score"), "avg_node_score", F.desc("runs"), "prompt_key", "prompt_version")


def prompt_score_matrix(cohorts: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Prompt x version matrix of the mean score: a row per prompt and a map
    from version to score, which holds every version; named ``versions`` also
    become columns."""
    means = cohorts.groupBy("prompt_key", "prompt_version").agg(F.avg("avg_node_score").alias("s"))
    rows = means.groupBy("prompt_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prompt_version", "s")))).alias("by_version"))
    return rows.select("prompt_key", "by_version", *[F.try_element_at("by_version", F.lit(v)).alias(v) for v in versions or ()])


def score_trend(requests: DataFrame, prompt_scores: DataFrame, filters: Mapping | None = None) -> DataFrame:
    return filtered_requests(requests, prompt_scores, filters).groupBy(F.to_date("ts").alias("date")).agg(
        F.avg("final_score").alias("avg_score"), F.count("*").alias("runs")).orderBy("date")


def top_root_causes(requests: DataFrame, prompt_scores: DataFrame, filters: Mapping | None = None, limit: int = 10) -> DataFrame:
    return filtered_requests(requests, prompt_scores, filters).groupBy("root_cause").agg(
        F.count("*").alias("runs")).orderBy(F.desc("runs"), "root_cause").limit(int(limit))


def best_worst_cohorts(cohorts: DataFrame, n: int = 10) -> DataFrame:
    tie = [F.desc("runs"), "prompt_key", "prompt_version"]
    worst = cohorts.orderBy("avg_node_score", *tie).limit(n).withColumn("side", F.lit("worst"))
    best = cohorts.orderBy(F.desc("avg_node_score"), *tie).limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


EVALUATION_JSON = (
    "final_score double, correctness double, completeness double, relevance double, groundedness double, "
    "root_cause string, judge_mode string, node_scores map<string,string>")


def run_detail(requests: DataFrame, nodes: DataFrame, node_scores: DataFrame, request_ids: list[str]) -> DataFrame:
    """One nested record per requested run: its latest request row, its nodes
    in order, and the recorded scores merged into the parsed evaluation."""
    of = lambda df: df.filter(F.col("request_id").isin(*request_ids))
    latest = of(requests).groupBy("request_id").agg(F.max_by(F.struct("*"), "ts").alias("r")).select("r.*")
    entry = F.struct("pos", "node", "status", "duration_sec", "row_count", "sql_query", "metrics_json",
                     "failure_reasons_json")
    log = of(nodes).groupBy("request_id").agg(F.sort_array(F.collect_list(entry)).alias("trace_log"))
    scores = of(node_scores).groupBy("request_id", "node").agg(F.max("score").alias("score")).groupBy("request_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "score")))).alias("node_scores"))
    parsed = F.from_json("evaluation_json", EVALUATION_JSON)
    recorded = F.transform_values(parsed["node_scores"], lambda _, v: v.try_cast("double"))
    return latest.join(log, "request_id", "left").join(scores, "request_id", "left").select(
        "request_id", "ts", "query", "intent", F.col("response_text").alias("text"),
        F.struct(
            "final_score", "correctness", "completeness", "relevance", "groundedness",
            F.coalesce(F.nullif("root_cause", F.lit("")), F.lit("unknown")).alias("root_cause"), "judge_mode",
            F.coalesce("node_scores", recorded).alias("node_scores")).alias("evaluation"),
        F.coalesce("trace_log", F.expr("array()")).alias("trace_log"),
        F.coalesce(F.transform("trace_log", lambda n: n["node"]), F.expr("array()")).alias("nodes_executed"),
        "version_json", "prompt_versions_json")


def node_timeline(payloads: DataFrame) -> DataFrame:
    """Nodes of every run with duration, status, counts and colour band."""
    score = F.try_element_at("evaluation.node_scores", F.col("e.node")).try_cast("double")
    status = F.coalesce("e.status", F.lit("unknown"))
    band = (
        F.when(score < 0.6, "lightcoral").when(score < 0.8, "khaki").when(score.isNotNull(), "lightgreen")
        .when(status == "success", "lightgreen").otherwise("lightcoral"))
    return node_events(payloads).select(
        "request_id", "pos", "e.node", F.coalesce("e.duration", F.lit(0.0)).alias("duration_sec"), status.alias("status"),
        F.greatest(F.coalesce(F.size("e.sql_events"), F.lit(0)), F.lit(0)).alias("sql_events"),
        F.coalesce("e.row_count", F.lit(0)).alias("row_count"), band.alias("band"))


def trace_root_cause(payloads: DataFrame) -> DataFrame:
    """First node in order with SQL errors, no tool called, or unknown intent."""
    name = lambda fallback: F.coalesce(F.nullif("e.node", F.lit("")), F.lit(fallback))
    m = "e.metrics"
    cause = (
        F.when(F.coalesce(f"{m}.sql_errors_delta", F.lit(0)) > 0, name("investigate_data"))
        .when(F.coalesce(f"{m}.tool_called", F.lit(1)) == 0, name("investigate_data"))
        .when(F.coalesce(f"{m}.intent_is_unknown", F.lit(0)) == 1, name("detect_intent")))
    found = node_events(payloads).withColumn("cause", cause).filter("cause IS NOT NULL").groupBy("request_id").agg(
        F.min_by("cause", "pos").alias("cause"))
    return payloads.select("request_id").join(found, "request_id", "left").select(
        "request_id", F.coalesce("cause", F.lit("unknown")).alias("root_cause"))


def recomputed_final_score(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", final_score_of(
        "correctness", "groundedness", "relevance", "completeness").alias("final_score"))


def chat_metrics(payloads: DataFrame, latency: str = "latency_sec") -> DataFrame:
    results = F.coalesce(F.map_values("tool_results"), F.expr("array()"))
    calls = F.size(results)
    failed = F.size(F.filter(results, lambda r: r["error"].isNotNull()))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return payloads.select(
        "request_id", settle(latency, 2).alias("latency_sec"), calls.alias("tools_called"),
        size("nodes_executed").alias("nodes_executed_count"),
        F.coalesce("token_usage.prompt", F.lit(0)).alias("tokens_prompt"),
        F.coalesce("token_usage.completion", F.lit(0)).alias("tokens_completion"),
        size("failure_reasons").alias("failure_count"),
        F.when(calls > 0, settle((calls - failed) / calls, 3)).otherwise(1.0).alias("sql_success_rate"))


def evidence_count(payloads: DataFrame) -> DataFrame:
    """Tool results without an error that carry rows or a known section."""
    results = F.coalesce(F.map_values("tool_results"), F.expr("array()"))
    known = F.array(*[F.lit(s) for s in EVIDENCE_SECTIONS])
    usable = F.size(F.filter(results, lambda r: r["error"].isNull() & (
        (F.coalesce(r["data_rows"], F.lit(0)) > 0)
        | F.coalesce(F.arrays_overlap(r["sections"], known), F.lit(False)))))
    lacking = (F.coalesce("intent", F.lit("")) != "casual_conversation") & (usable == 0)
    return payloads.select(
        "request_id", usable.alias("evidence_count"),
        F.when(lacking, "insufficient_evidence").otherwise("").alias("failure"))

