"""Conversation and message tables.

conversations: conversation_id, customer_name, mode, created_ts, context_json
messages:      conversation_id, message_index, role, content, ts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.numbering import number_within
from faultloom.params import checked_limit
from faultloom.sources.readers import latest_by_key


def _clean(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col).cast("string"), F.lit("")))


def recent_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` messages of every conversation, oldest first.

    Spark turns a row number with an upper bound into a per-task group limit,
    so a conversation of any length sends at most ``n`` rows per task.
    """
    n = checked_limit(n, 12, 1)
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("message_index"))
    kept = messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    return kept.select("conversation_id", "message_index", "role", "content", "ts").orderBy(
        "conversation_id", "message_index")


def next_message_index(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg((F.max("message_index") + 1).alias("next_index"))


def assign_indexes(messages: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Consecutive indexes for a batch, after the ones already stored.

    Rows without a conversation or role are dropped; those without a time come
    first. The batch is numbered hour by hour, so that one busy conversation is
    not sorted in one task.
    """
    usable = batch.withColumns({"conversation_id": _clean("conversation_id"), "role": _clean("role")}).filter(
        "conversation_id <> '' AND role <> ''")
    hour = F.date_trunc("hour", order[0])
    numbered = number_within(usable, ["conversation_id"], hour, list(order))
    return numbered.join(next_message_index(messages), "conversation_id", "left").withColumn(
        "message_index", F.coalesce("next_index", F.lit(0)) + F.col("rn") - 1).drop("rn", "next_index")


def latest_conversation(conversations: DataFrame) -> DataFrame:
    newest = latest_by_key(conversations, ["conversation_id"], ["created_ts"])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return newest.withColumn(
        "context", F.coalesce(F.from_json("context_json", "map<string,string>"), empty)).drop("context_json")


def new_conversations(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows to insert: the first request of every id that is not stored yet.
    A request without an id starts a conversation of its own."""
    rows = requests.select(
        F.coalesce(F.nullif(_clean("conversation_id"), F.lit("")), F.uuid()).alias("conversation_id"),
        _clean("customer_name").alias("customer_name"),
        F.coalesce(F.nullif(_clean("mode"), F.lit("")), F.lit("general")).alias("mode"), "created_ts",
        F.coalesce("context_json", F.lit("{}")).alias("context_json"))
    first = F.min_by(F.struct("customer_name", "mode", "created_ts", "context_json"),
                     F.struct("created_ts", "customer_name", "mode", "context_json"))
    return rows.groupBy("conversation_id").agg(first.alias("r")).select("conversation_id", "r.*").join(
        conversations.select("conversation_id"), "conversation_id", "left_anti")


def scope_violations(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests whose customer differs from their conversation's."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    owner = latest_by_key(conversations, ["conversation_id"], ["created_ts"]).select(
        "conversation_id", norm("customer_name").alias("_owner"))
    return requests.join(owner, "conversation_id").withColumn("_asked", norm("customer_name")).filter(
        "_owner <> '' AND _asked <> '' AND _owner <> _asked").drop("_owner", "_asked")


def context_window(messages: DataFrame, queries: DataFrame, n: int = 12) -> DataFrame:
    """Messages handed to the assistant: the user and assistant turns among the
    last ``n``, then the current query unless it already is the last turn."""
    kept = recent_messages(messages, n).filter(F.col("role").isin("user", "assistant")).join(
        queries.select("conversation_id"), "conversation_id", "left_semi").select(
        "conversation_id", F.col("message_index").alias("position"), "role", "content")
    last = kept.groupBy("conversation_id").agg(
        F.max_by(F.struct("role", "content"), "position").alias("m"), F.max("position").alias("p"))
    asked = queries.join(last, "conversation_id", "left")
    repeated = F.coalesce((F.col("m.role") == "user") & (F.col("m.content") == F.col("query_text")), F.lit(False))
    added = asked.filter(~repeated).select(
        "conversation_id", (F.coalesce("p", F.lit(-1)) + 1).alias("position"), F.lit("user").alias("role"),
        F.col("query_text").alias("content"))
    return kept.unionByName(added)
