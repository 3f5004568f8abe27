"""Audits over logged queries and planner events, one flag column per finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions.catalogue import ALLOWED_TABLES, CATALOGUE, DEFAULT_TABLES, Entry
from faultloom.functions.scoring import count_where

# fixed values: keywords a read-only query must not hold
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "RENAME", "ATTACH", "DETACH", "GRANT",
    "REVOKE", "KILL")
# fixed values: aggregate functions looked for
AGGREGATES = ("count", "sum", "avg", "min", "max", "uniqexact", "topk")


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def audit_readonly(log: DataFrame, col: str = "query") -> DataFrame:
    text = F.trim(_text(col))
    starts = text.rlike(r"(?i)^\(*(SELECT|WITH)")
    forbidden = text.rlike(r"(?i)\b(" + "|".join(FORBIDDEN) + r")\b")
    return log.withColumn("readonly_finding", F.when(~starts, "not_a_select").when(forbidden, "forbidden_keyword"))


def referenced_tables(col: str = "query") -> Column:
    """Names after FROM and JOIN: unquoted, without database, lower case."""
    # what stands behind each keyword, up to the next blank, comma, bracket or semicolon
    behind = F.slice(F.split(F.lower(_text(col)), r"\b(?:from|join)(?=\s)"), 2, 1 << 30)
    names = F.transform(behind, lambda t: F.element_at(F.split(F.ltrim(F.translate(t, "\n\t\r", "   ")), "[ ,;()]", 2), 1))
    bare = F.transform(names, lambda t: F.trim(F.substring_index(t, ".", -1), F.lit('`"')))
    return F.filter(bare, lambda t: t != "")


def audit_tables(log: DataFrame, col: str = "query", allowed: Sequence[str] = ALLOWED_TABLES) -> DataFrame:
    """Adds the disallowed tables of every query. The allow-list is a short
    literal, so no join is needed."""
    known = F.array(*[F.lit(t.lower()) for t in allowed])
    return log.withColumn("disallowed_tables", F.array_except(referenced_tables(col), known))


def audit_scope(log: DataFrame, col: str = "query") -> DataFrame:
    """``log`` carries the request context: customer_name, vehicle_number,
    uniqueid, dtc_code (empty when not set)."""
    low = F.lower(_text(col))
    value = lambda c: F.trim(_text(c))
    quoted = lambda c: F.concat(
        F.lit("'"), F.lower(F.replace(value(c), F.lit("'"), F.lit("''"))), F.lit("'"))
    named = lambda c: (value(c) != "") & F.contains(low, quoted(c))
    finding = (
        F.when((value("customer_name") != "") & ~low.contains("customer_name"), "customer_filter_missing")
        .when((value("customer_name") != "") & ~named("customer_name"), "customer_mismatch")
        .when((value("vehicle_number") != "") & ~(named("vehicle_number") | named("uniqueid")), "vehicle_scope_missing")
        .when((value("dtc_code") != "") & ~named("dtc_code"), "dtc_scope_missing"))
    return log.withColumn("scope_finding", finding)


def audit_shape(log: DataFrame, col: str = "query", fact_table: str = "vehicle_fault_master") -> DataFrame:
    low = F.lower(_text(col))
    grouped = low.contains("group by")
    raw = low.contains(fact_table) & ~grouped & ~low.contains("limit")
    has_agg = low.rlike("(" + "|".join(AGGREGATES) + r")\(")
    # the columns stand between the first "select" and the first "from" after it
    after = F.element_at(F.split(low, r"\bselect\b", 2), -1)
    listed = F.split(after, r"\bfrom\b", 2)
    items = F.when(F.size(listed) > 1, F.split(listed[0], ",")).otherwise(F.array().cast("array<string>"))
    plain = F.exists(items, lambda p: (F.trim(p) != "") & ~p.rlike(r"\b(" + "|".join(AGGREGATES) + r")\s*\("))
    return log.withColumns({
        "raw_fact_scan": raw.cast("int"), "select_star": low.contains("select *").cast("int"),
        "ungrouped_columns": (has_agg & ~grouped & plain).cast("int")})


def audit_result(events: DataFrame) -> DataFrame:
    """Failed and empty executions per tool. With a column ``first_row`` (a map)
    also those whose first row has no value."""
    blank = F.lit(False)
    if "first_row" in events.columns:
        filled = F.exists(F.map_values("first_row"), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
        blank = F.col("first_row").isNotNull() & ~F.coalesce(filled, F.lit(False))
    done = F.col("success") == 1
    return events.groupBy("tool").agg(
        F.count("*").alias("executions"), count_where(F.col("success") == 0).alias("failed"),
        count_where(done & (F.col("row_count") == 0)).alias("empty"),
        count_where(done & (F.col("row_count") > 0) & blank).alias("blank_first_row"))


def relevant_tables(
    questions: DataFrame, k: int = 4, catalogue: Sequence[Entry] = CATALOGUE, question: str = "question",
    tool: str | None = None,
) -> DataFrame:
    """The ``k`` best catalogue tables per question, ranked inside the row:
    the catalogue is a short literal, so neither a join nor a window is needed."""
    tool_name = _text(tool) if tool else F.lit("")
    phrase = F.replace(F.replace(tool_name, F.lit("get_"), F.lit("")), F.lit("_"), F.lit(" "))
    asked = F.concat(F.lower(_text(question)), F.lit(" "), F.lower(tool_name))
    named = F.when((tool_name != "") & F.contains(asked, phrase), 1).otherwise(0)

    def terms(e: Entry) -> list[str]:
        words = [w for w in e.description.lower().split() if len(w) > 4]
        return [*[u.lower() for u in e.use_cases], *words, *[c.lower() for c in e.columns]]

    # every distinct term is looked for once, whichever tables it belongs to
    every = F.array(*[F.lit(t) for t in sorted({t for e in catalogue for t in terms(e)})])
    found = F.element_at(F.transform(F.array(asked), lambda a: F.filter(every, lambda t: F.contains(a, t))), 1)
    scored = F.array(*[
        F.struct(
            (-(F.size(F.filter(F.array(*[F.lit(t) for t in terms(e)]), lambda t: F.array_contains("_found", t)))
               + F.col("_named") + (1 if e.priority == "aggregated" else 0))).alias("neg_score"),
            F.lit(e.table).alias("table"))
        for e in catalogue])
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg_score"] < 0)), 1, k)
    present = {e.table for e in catalogue}
    fallback = F.array(*[
        F.struct(F.lit(0).alias("neg_score"), F.lit(t).alias("table")) for t in DEFAULT_TABLES if t in present][:k])
    picked = F.when(F.size(best) > 0, best).otherwise(fallback) if any(t in present for t in DEFAULT_TABLES) else best
    ranked = questions.withColumns({"_found": found, "_named": named}).select("*", F.posexplode(picked).alias("_p", "_t"))
    return ranked.select(
        *questions.columns, (F.col("_p") + 1).alias("rank"), F.col("_t.table").alias("table_name"),
        (-F.col("_t.neg_score")).alias("score"))


def planner_retry_stats(events: DataFrame) -> DataFrame:
    """Runs, repair attempts and retry reasons of planner events by tool.
    ``retry_reasons`` is an array; tools without retries keep a row."""
    totals = events.groupBy("tool").agg(
        F.count("*").alias("runs"), F.sum("fix_attempts").alias("fix_attempts"),
        count_where(F.col("success") == 1).alias("succeeded"))
    reasons = events.select("tool", F.explode("retry_reasons").alias("reason")).groupBy("tool", "reason").agg(
        F.count("*").alias("times"))
    return totals.join(reasons, "tool", "left").select(
        "tool", "runs", "fix_attempts", "succeeded", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("times", F.lit(0)).alias("times"))
