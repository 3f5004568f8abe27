"""Scoring of evaluation runs: questions joined with recorded results.

questions: id, dataset, question, expected_intent, expected_tools,
           expected_output_contains
results:   id, text, intent, tools_called, sql_events, trace_log, token_usage,
           failure_reasons, latency_sec, and optionally judge, a struct of
           correctness, relevance, completeness, hallucination_risk
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import count_where, settle


def _words(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def _share(part: Column, whole: Column, if_none: Column | float) -> Column:
    other = if_none if isinstance(if_none, Column) else F.lit(if_none)
    return F.when(whole > 0, part / whole).otherwise(other)


def tool_prf(expected: str = "expected_tools", called: str = "tools_called") -> dict[str, Column]:
    """Recall, precision and F1 of the called tools against the expected ones."""
    want, got = F.array_distinct(_words(expected)), F.array_distinct(_words(called))
    both = F.size(F.array_intersect(want, got))
    recall = _share(both, F.size(want), 1.0)
    precision = _share(both, F.size(got), 1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"tool_recall": recall, "tool_precision": precision, "tool_f1": f1}


def keyword_hits(expected: str = "expected_output_contains", text: str = "text") -> Column:
    low, words = F.lower(F.coalesce(text, F.lit(""))), _words(expected)
    return _share(F.size(F.filter(words, lambda w: F.contains(low, F.lower(w)))), F.size(words), 1.0)


def heuristic_scores(intent_match: Column, hits: Column, recall: Column) -> dict[str, Column]:
    risk = F.greatest(F.lit(0.0), settle(1.0 - (0.6 * hits + 0.4 * recall), 3))
    return {
        "correctness": settle(hits, 3), "relevance": settle(0.6 * intent_match + 0.4 * hits, 3),
        "completeness": settle(0.5 * hits + 0.5 * recall, 3), "hallucination_risk": risk,
    }


def sql_metrics(events: str = "sql_events", expected: str = "expected_tools") -> dict[str, Column]:
    ev = F.coalesce(F.col(events), F.expr("array()"))
    n, want = F.size(ev), F.array_distinct(_words(expected))
    none = F.when(F.size(want) == 0, 1.0).otherwise(0.0)
    tools = F.array_distinct(F.filter(F.transform(
        ev, lambda e: F.trim(F.coalesce(e["tool"], F.lit("")))), lambda t: t != ""))
    shaped = F.filter(ev, lambda e: F.lower(F.trim(F.coalesce(e["query"], F.lit("")))).rlike("^(select|with)"))
    alignment = _share(F.size(F.array_intersect(want, tools)), F.size(want), 1.0)
    shape = _share(F.size(shaped), n, none)
    return {
        "sql_query_count": n,
        "sql_success_rate": settle(_share(F.size(F.filter(ev, lambda e: e["success"])), n, none), 3),
        "sql_tool_alignment": settle(alignment, 3), "sql_shape_validity": settle(shape, 3),
        "sql_relevance_score": settle(0.7 * alignment + 0.3 * shape, 3),
    }


def node_latency_stats(trace_log: str = "trace_log") -> dict[str, Column]:
    """Per-question node latencies, computed inside the row's own array."""
    nodes = F.filter(F.coalesce(F.col(trace_log), F.expr("array()")), lambda e: e["type"] == "node")
    duration = lambda e: F.coalesce(e["duration"], F.lit(0.0))
    name = lambda e: F.coalesce(e["node"], F.lit("unknown"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + duration(e))
    names = F.array_sort(F.array_distinct(F.transform(nodes, name)))
    by_node = F.transform(names, lambda n: F.struct(
        n, settle(total(F.filter(nodes, lambda e: name(e) == n)), 3)))
    return {
        "node_events_count": F.size(nodes), "node_latency_total_sec": settle(total(nodes), 3),
        "node_latency_avg_sec": settle(_share(total(nodes), F.size(nodes), 0.0), 3),
        "node_latency_max_sec": settle(F.coalesce(F.array_max(F.transform(nodes, duration)), F.lit(0.0)), 3),
        "node_latency_by_node": F.map_from_entries(by_node),
    }


def _of_events(col: str, *fields: str) -> Column:
    return F.transform(col, lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def score_questions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Every question with its scores; recorded judge scores win over the heuristic."""
    # of the events, only what is scored passes the join
    joined = questions.join(results.withColumns({
        "sql_events": _of_events("sql_events", "tool", "query", "success"),
        "trace_log": _of_events("trace_log", "type", "node", "duration")}), "id", "left")
    prf, hits = tool_prf(), keyword_hits()
    match = F.when(F.coalesce("intent", F.lit("")) == F.coalesce("expected_intent", F.lit("")), 1).otherwise(0)
    heuristic = heuristic_scores(match, hits, prf["tool_recall"])
    has_judge = "judge" in results.columns
    judged = F.col("judge").isNotNull() if has_judge else F.lit(False)
    score = {
        k: F.when(judged, settle(F.col(f"judge.{k}"), 3)).otherwise(v) if has_judge else v
        for k, v in heuristic.items()}
    tokens = [F.coalesce(f"token_usage.{c}", F.lit(0)).alias(f"tokens_{c}") for c in ("prompt", "completion")]
    base = joined.select(
        "id", "dataset", "question", F.coalesce("expected_intent", F.lit("")).alias("expected_intent"),
        F.coalesce("intent", F.lit("")).alias("actual_intent"), match.alias("intent_match"),
        F.array_sort(F.array_distinct(_words("expected_tools"))).alias("expected_tools"),
        F.array_sort(F.array_distinct(_words("tools_called"))).alias("actual_tools"),
        *[settle(v, 3).alias(k) for k, v in prf.items()], settle(hits, 3).alias("keyword_hits"),
        *[v.alias(k) for k, v in score.items()],
        *[v.alias(k) for k, v in sql_metrics().items()],
        F.when(judged, "llm").otherwise("heuristic").alias("judge_mode"),
        F.coalesce("latency_sec", F.lit(0.0)).alias("latency_sec"), *tokens,
        *[v.alias(k) for k, v in node_latency_stats().items()],
        _words("failure_reasons").alias("failure_reasons"))
    return base.withColumns({
        "hallucination_score": settle(1.0 - F.col("hallucination_risk"), 3),
        "groundedness_score": settle(1.0 - F.col("hallucination_risk"), 3),
        "tokens_total": F.col("tokens_prompt") + F.col("tokens_completion"),
    })


# fixed values: summary weights
WEIGHTS = {
    "intent_accuracy": 0.18, "avg_tool_f1": 0.18, "avg_sql_success_rate": 0.16, "avg_sql_relevance_score": 0.16,
    "avg_correctness": 0.14, "avg_completeness": 0.10, "avg_groundedness_score": 0.08,
}


def _summary_columns() -> list[Column]:
    mean = {
        "intent_accuracy": "intent_match", "avg_tool_f1": "tool_f1", "avg_sql_success_rate": "sql_success_rate",
        "avg_sql_relevance_score": "sql_relevance_score", "avg_correctness": "correctness",
        "avg_completeness": "completeness", "avg_groundedness_score": "groundedness_score",
        "avg_tool_recall": "tool_recall", "avg_tool_precision": "tool_precision", "avg_keyword_accuracy": "keyword_hits",
        "avg_relevance": "relevance", "avg_hallucination_risk": "hallucination_risk",
        "avg_hallucination_score": "hallucination_score",
    }
    weighted = sum((w * F.avg(mean[name]) for name, w in WEIGHTS.items()), F.lit(0.0))
    failed = F.size("failure_reasons") > 0
    too_long = F.exists("failure_reasons", lambda r: F.contains(r, F.lit("context_length_exceeded")))
    share = lambda cond: settle(F.try_divide(count_where(cond), F.count("*")), 4)
    return [
        F.count("*").alias("questions_evaluated"),
        *[settle(F.avg(c), 4).alias(name) for name, c in mean.items()],
        settle(F.avg("latency_sec"), 3).alias("avg_latency_sec"),
        settle(F.avg("node_latency_avg_sec"), 3).alias("avg_node_latency_sec"),
        settle(F.avg("node_latency_max_sec"), 3).alias("avg_node_max_latency_sec"),
        *[F.coalesce(F.sum(f"tokens_{c}"), F.lit(0)).alias(f"total_tokens_{out}")
          for c, out in (("prompt", "prompt"), ("completion", "completion"), ("total", "all"))],
        *[settle(F.avg(f"tokens_{c}"), 3).alias(f"avg_{out}tokens_per_question")
          for c, out in (("total", ""), ("prompt", "prompt_"), ("completion", "completion_"))],
        share(failed).alias("failure_rate"), count_where(failed).alias("failed_questions_count"),
        count_where(~failed).alias("successful_questions_count"), settle(weighted, 4).alias("weighted_score"),
        share(F.col("judge_mode") == "llm").alias("llm_judge_ratio"), share(too_long).alias("context_length_error_rate"),
        share(F.size("actual_tools") > 0).alias("tool_usage_rate"),
    ]


def eval_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(*_summary_columns())


def eval_by_dataset(scored: DataFrame, by: str = "dataset") -> DataFrame:
    """The summary per dataset (or intent) with the total as row ``all``."""
    return scored.rollup(by).agg(*_summary_columns(), F.grouping(by).alias("_all")).withColumn(
        by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))).drop("_all")


# fixed values: metrics of the short profile
SHORT_PROFILE = (*WEIGHTS, "weighted_score")


def metric_profile(summary: DataFrame, profile: str = "mvp") -> DataFrame:
    """The summary columns of a profile: all of them for ``full``."""
    return summary if profile == "full" else summary.select(*[c for c in summary.columns if c in SHORT_PROFILE])
