"""Declared schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


DTC_HISTORY = _struct(
    ("uniqueid", S), ("ts", TS), ("dtc_code", T.ArrayType(S)), ("lat", D), ("lng", D), ("dtc_pgn", S),
)
ENGINE_CYCLES = _struct(("uniqueid", S), ("cycle_end_ts", TS))

# Attributes of the code dimension with their defaults, in table order.
DTC_MASTER_DEFAULTS = {
    "system": "", "subsystem": "", "description": "", "primary_cause": "", "secondary_causes": "",
    "symptoms": "", "impact_if_unresolved": "", "fuel_mileage_impact": "", "vehicle_health_impact": "",
    "severity_level": 1, "safety_risk_level": "", "action_required": "", "repair_complexity": "",
    "estimated_repair_hours": 0.0, "driver_related": 0, "driver_behaviour_category": "",
    "driver_behaviour_trigger": "", "driver_training_required": 0, "fleet_management_action": "",
    "recommended_preventive_action": "", "oem_specific": 0, "manufacturer_notes": "",
}

NODE_METRICS = _struct(
    ("sql_errors_delta", I), ("tool_called", I), ("intent_is_unknown", I),
)
SQL_EVENT = _struct(
    ("node", S), ("tool", S), ("query", S), ("success", T.BooleanType()), ("row_count", L),
    ("duration_sec", D), ("error", S),
)
TRACE_NODE = _struct(
    ("type", S), ("node", S), ("customer_name", S), ("status", S), ("duration", D), ("row_count", L), ("sql_query", S), ("metrics", NODE_METRICS),
    ("input_summary", _struct(("context", T.MapType(S, S)))),
    ("output_summary", T.MapType(S, S)), ("failure_reasons", T.ArrayType(S)),
    ("sql_events", T.ArrayType(SQL_EVENT)),
)
TOOL_RESULT = _struct(
    ("tool", S), ("generated_by", S), ("generated_query", S), ("fix_attempts", I),
    ("selected_tables", T.ArrayType(S)), ("error", S), ("retry_reasons", T.ArrayType(S)),
    ("data_rows", L), ("sections", T.ArrayType(S)),
)
EVALUATION = _struct(
    ("final_score", D), ("correctness", D), ("completeness", D), ("relevance", D), ("groundedness", D),
    ("root_cause", S), ("judge_mode", S), ("node_scores", T.MapType(S, S)),
)
VERSION = _struct(
    ("release_version", S), ("service_version", S), ("model_name", S), ("env_name", S), ("git_commit", S),
    ("prompt_versions", T.MapType(S, S)), ("prompt_catalog", T.MapType(S, S)),
)
TOKENS = _struct(("prompt", L), ("completion", L))
TRACE_RUN = _struct(
    ("id", S), ("start_time", TS),
    ("inputs", _struct(("query", S))),
    ("outputs", _struct(
        ("text", S), ("messages", T.ArrayType(_struct(("content", S)))), ("intent", S),
        ("trace_log", T.ArrayType(TRACE_NODE)), ("evaluation", EVALUATION), ("nodes_executed", T.ArrayType(S)),
        ("version", VERSION), ("tools_called", T.ArrayType(S)), ("sql_events", T.ArrayType(SQL_EVENT)),
        ("token_usage", TOKENS), ("failure_reasons", T.ArrayType(S)),
    )),
    ("extra", _struct(("metadata", _struct(("request_id", S), ("query", S), ("intent", S),
                                           ("env_name", S), ("release_version", S))))),
)
EVAL_QUESTION = _struct(
    ("id", S), ("question", S),
    ("context", _struct(("mode", S), ("customer_name", S), ("vehicle_number", S), ("dtc_code", S))),
    ("expected_intent", S), ("expected_tools", T.ArrayType(S)),
    ("expected_output_contains", T.ArrayType(S)), ("reference_answer", S),
)
