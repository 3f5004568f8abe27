"""Assistant traces: one nested payload per run, flattened to eight tables.

A payload row carries ``request_id, ts, query, text, intent, customer_name,
mode, trace_log, sql_events, planner_events, tools_called, nodes_executed,
failure_reasons, token_usage, evaluation, version``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import settle

# fixed values: graph node -> prompt key
NODE_TO_PROMPT = {
    "detect_intent": "intent",
    "investigate_data": "investigate",
    "analyze_faults": "fault_analysis",
    "reason_root_cause": "root_cause",
    "assess_maintenance": "maintenance",
    "generate_recommendation": "recommendation",
    "explain": "explain",
}
# fixed values: intents the assistant knows
KNOWN_INTENTS = (
    "vehicle_investigation", "dtc_investigation", "fault_correlation", "fleet_health", "trend_analysis",
    "maintenance_prioritization", "unknown", "casual_conversation",
)
# fixed values: sections of a tool result that count as evidence
EVIDENCE_SECTIONS = ("summary", "fleet_snapshot", "recent_trend", "status", "fault_summary")


def _text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def _num(col: str | Column, dtype: str = "double") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast(dtype), F.lit(0).cast(dtype))


def _len(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def _flag(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("int"), F.lit(0))


def _json(col: str | Column, empty: str) -> Column:
    return F.coalesce(F.to_json(col), F.lit(empty))


def planner_events(payloads: DataFrame, tool_results: str = "tool_results") -> DataFrame:
    """Add ``planner_events``: tool results that bear a planner's signature."""
    signed = F.filter(
        F.map_entries(tool_results),
        lambda e: (_text(e["value"]["generated_by"]) != "") | e["value"]["generated_query"].isNotNull()
        | e["value"]["fix_attempts"].isNotNull() | (_len(e["value"]["selected_tables"]) > 0))
    event = lambda e: F.struct(
        e["key"].alias("tool_call_id"), F.coalesce(e["value"]["tool"], F.lit("unknown")).alias("tool"),
        F.coalesce(F.nullif(e["value"]["generated_by"], F.lit("")), F.lit("unknown")).alias("generated_by"),
        _text(e["value"]["generated_query"]).alias("generated_query"),
        F.coalesce(e["value"]["selected_tables"], F.array().cast("array<string>")).alias("selected_tables"),
        F.array_join(F.coalesce(e["value"]["selected_tables"], F.array().cast("array<string>")), ",")
        .alias("selected_tables_csv"),
        _num(e["value"]["fix_attempts"], "int").alias("fix_attempts"),
        F.when(e["value"]["error"].isNull(), 1).otherwise(0).alias("success"),
        _text(e["value"]["error"]).alias("error"),
        F.coalesce(e["value"]["retry_reasons"], F.array().cast("array<string>")).alias("retry_reasons"))
    return payloads.withColumn("planner_events", F.coalesce(F.transform(signed, event), F.expr("array()")))


def trace_requests(payloads: DataFrame) -> DataFrame:
    ev, ver = "evaluation", "version"
    succeeded = F.size(F.filter("planner_events", lambda e: e["success"] == 1))
    fixes = F.aggregate("planner_events", F.lit(0), lambda acc, e: acc + e["fix_attempts"])
    return payloads.filter("request_id <> ''").select(
        "request_id", "ts", _text("query").alias("query"), _text("intent").alias("intent"),
        _text("customer_name").alias("customer_name"), _text("mode").alias("mode"), _text("text").alias("response_text"),
        *[_num(f"{ev}.{c}").alias(c)
          for c in ("final_score", "correctness", "completeness", "relevance", "groundedness")],
        _text(f"{ev}.root_cause").alias("root_cause"), _text(f"{ev}.judge_mode").alias("judge_mode"),
        _len("tools_called").alias("tools_called_count"), _len("nodes_executed").alias("nodes_executed_count"),
        _len("failure_reasons").alias("failure_count"), _num("token_usage.prompt", "long").alias("tokens_prompt"),
        _num("token_usage.completion", "long").alias("tokens_completion"),
        _json(ev, "{}").alias("evaluation_json"), _json(ver, "{}").alias("version_json"),
        *[_text(f"{ver}.{c}").alias(c) for c in ("release_version", "service_version", "model_name", "env_name")],
        _json(f"{ver}.prompt_versions", "{}").alias("prompt_versions_json"),
        _json("failure_reasons", "[]").alias("failure_reasons_json"),
        F.size("planner_events").alias("planner_events_count"), succeeded.alias("planner_success_count"),
        F.greatest(F.size("planner_events") - succeeded, F.lit(0)).alias("planner_error_count"),
        fixes.alias("planner_fix_attempts_sum"),
    )


def node_events(payloads: DataFrame) -> DataFrame:
    """Node entries of every trace log with their position, as column ``e``."""
    return payloads.select("*", F.posexplode("trace_log").alias("pos", "e")).filter("e.type = 'node'")


def trace_nodes(payloads: DataFrame) -> DataFrame:
    return node_events(payloads).select(
        "request_id", "ts", "pos", _text("e.node").alias("node"),
        F.coalesce(F.nullif("e.customer_name", F.lit("")), F.col("customer_name"), F.lit("")).alias("customer_name"),
        F.coalesce(F.nullif(F.try_element_at("e.input_summary.context", F.lit("mode")), F.lit("")), F.col("mode"), F.lit(""))
        .alias("mode"),
        F.coalesce(F.nullif("e.status", F.lit("")), F.lit("unknown")).alias("status"),
        _num("e.duration").alias("duration_sec"), _num("e.row_count", "long").alias("row_count"),
        _text("e.sql_query").alias("sql_query"), _json("e.metrics", "{}").alias("metrics_json"),
        _json("e.input_summary", "{}").alias("input_summary_json"),
        _json("e.output_summary", "{}").alias("output_summary_json"),
        _json("e.failure_reasons", "[]").alias("failure_reasons_json"),
    )


def trace_sql_events(payloads: DataFrame) -> DataFrame:
    return payloads.select("*", F.posexplode("sql_events").alias("pos", "e")).select(
        "request_id", "ts", "pos", _text("e.node").alias("node"), _text("e.tool").alias("tool"),
        _text("customer_name").alias("customer_name"), _text("mode").alias("mode"), _flag("e.success").alias("success"),
        _num("e.row_count", "long").alias("row_count"), _num("e.duration_sec").alias("duration_sec"),
        _text("e.query").alias("query"), _text("e.error").alias("error"),
    )


def trace_planner_events(payloads: DataFrame) -> DataFrame:
    return payloads.select("*", F.explode("planner_events").alias("e")).select(
        "request_id", "ts", "e.tool_call_id", "e.tool", _text("customer_name").alias("customer_name"),
        _text("mode").alias("mode"), "e.generated_by", "e.fix_attempts", "e.success",
        _json("e.selected_tables", "[]").alias("selected_tables_json"), "e.selected_tables_csv", "e.generated_query",
        "e.error", _json("e.retry_reasons", "[]").alias("retry_reasons_json"), _text("query").alias("query"),
    )


def _scores(payloads: DataFrame) -> DataFrame:
    """Node scores that read as a number."""
    return payloads.select("*", F.explode("evaluation.node_scores").alias("node", "_score")).withColumn(
        "score", F.col("_score").try_cast("double")).filter("score IS NOT NULL")


def trace_node_scores(payloads: DataFrame) -> DataFrame:
    return _scores(payloads).select(
        "request_id", "ts", "node", _text("customer_name").alias("customer_name"), _text("mode").alias("mode"), "score")


def _prompt_key(node: str | Column) -> Column:
    pairs = [F.lit(x) for kv in NODE_TO_PROMPT.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(node) if isinstance(node, str) else node)


def trace_prompt_scores(payloads: DataFrame) -> DataFrame:
    return _scores(payloads).withColumn("prompt_key", _prompt_key("node")).filter("prompt_key IS NOT NULL").select(
        "request_id", "ts", "prompt_key",
        _text(F.try_element_at("version.prompt_versions", F.col("prompt_key"))).alias("prompt_version"), "node",
        _text("customer_name").alias("customer_name"), _text("mode").alias("mode"), F.col("score").alias("node_score"),
        _num("evaluation.final_score").alias("final_score"), _text("evaluation.root_cause").alias("root_cause"),
        _text("intent").alias("intent"), _text("version.env_name").alias("env_name"),
        _text("version.release_version").alias("release_version"),
    )


def trace_prompt_versions(payloads: DataFrame) -> DataFrame:
    return payloads.select("*", F.explode("version.prompt_versions").alias("prompt_key", "prompt_version")).select(
        "request_id", "ts", "prompt_key", _text("prompt_version").alias("prompt_version"),
        _text("customer_name").alias("customer_name"), _text("mode").alias("mode"), _text("intent").alias("intent"),
        *[_text(f"version.{c}").alias(c)
          for c in ("env_name", "release_version", "service_version", "model_name", "git_commit")],
    )


def prompt_inventory_new(payloads: DataFrame, inventory: DataFrame) -> DataFrame:
    """Prompt texts of (key, version) pairs that the inventory does not hold yet."""
    seen = payloads.select("version", F.explode("version.prompt_versions").alias("prompt_key", "prompt_version")).select(
        "prompt_key", "prompt_version",
        _text(F.try_element_at("version.prompt_catalog", F.col("prompt_key"))).alias("prompt"))
    pairs = seen.filter("prompt_key <> '' AND prompt_version <> ''").groupBy("prompt_key", "prompt_version").agg(
        F.min("prompt").alias("prompt"))
    return pairs.join(inventory.select("prompt_key", "prompt_version"), ["prompt_key", "prompt_version"], "left_anti")


def node_stage_metrics(nodes: DataFrame) -> DataFrame:
    """Metrics derived per graph node. A metric that belongs to another node is null.

    ``nodes``: request_id, pos, node, intent, context (map), scope_hints,
    tools_used, tool_results (map), sql_events, output_text.
    """
    of = lambda *names: F.col("node").isin(*names)
    has = lambda key: F.when(_text(F.try_element_at("context", F.lit(key))) != "", 1).otherwise(0)
    yes = lambda cond: F.when(cond, 1).otherwise(0)
    results = F.coalesce(F.map_values("tool_results"), F.expr("array()"))
    failed = F.size(F.filter(results, lambda r: r["error"].isNotNull()))
    sql = F.coalesce("sql_events", F.expr("array()"))
    low = F.lower(_text("output_text"))
    writers = of("analyze_faults", "reason_root_cause", "assess_maintenance", "generate_recommendation")
    intent = F.trim(_text("intent"))
    per_node = [
        (of("detect_intent"), {
            "intent_valid": yes(intent != ""), "intent_known": yes(intent.isin(*KNOWN_INTENTS)),
            "intent_is_unknown": yes(intent == "unknown")}),
        (of("build_context"), {
            "scope_hints_count": _len("scope_hints"), "has_customer_scope": has("customer_name"),
            "has_vehicle_scope": has("vehicle_number"), "has_dtc_scope": has("dtc_code"), "has_mode_scope": has("mode")}),
        (of("investigate_data"), {
            "tool_called": yes(_len("tools_used") > 0), "tool_count": _len("tools_used"),
            "tool_results_count": F.size(results), "tool_error_count": failed,
            "tool_error_rate": settle(failed / F.greatest(F.size(results), F.lit(1)), 3),
            "sql_query_count": F.size(sql), "sql_success_count": F.size(F.filter(sql, lambda e: e["success"]))}),
        (writers, {
            "output_chars": F.length(_text("output_text")),
            "output_non_empty": yes(F.trim(_text("output_text")) != "")}),
        (of("explain"), {
            "final_answer_chars": F.length(low), "final_answer_non_empty": yes(F.trim(low) != ""),
            **{f"has_{s}_section": yes(low.contains(s)) for s in ("problem", "cause", "impact", "action")}}),
    ]
    cols = [F.when(cond, value).alias(name) for cond, group in per_node for name, value in group.items()]
    return nodes.select("request_id", "pos", "node", *cols)


def run_deltas(nodes: DataFrame) -> DataFrame:
    """Change of each node against its input state: tokens, tools, failures and
    SQL events. ``nodes`` carries ``pre`` and ``post`` structs of the counters."""
    out = [(F.col(f"post.{c}") - F.col(f"pre.{c}")).alias(f"{c}_delta")
           for c in ("token_prompt", "token_completion", "tools_used", "failures", "sql_events", "sql_errors")]
    return nodes.select("request_id", "pos", "node", *out)


def last_metrics_by_node(payloads: DataFrame) -> DataFrame:
    """The metrics of the last entry of every named node of a trace."""
    return node_events(payloads).filter("e.node <> '' AND e.metrics IS NOT NULL").groupBy(
        "request_id", F.col("e.node").alias("node")).agg(F.max_by("e.metrics", "pos").alias("metrics"))
