"""Continuous forms of the event, episode, trend and state operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultloom.operators.events import events_exploded
from faultloom.params import Params


def stream_events_exploded(
    history: DataFrame, vehicles: DataFrame, params: Params | None = None, dedupe_within: str | None = None,
) -> DataFrame:
    """Events of known vehicles from a stream of messages.

    With ``dedupe_within`` a message delivered again inside that time is
    dropped; the state then covers only the watermark's span.
    """
    events = events_exploded(history, vehicles, params)
    if dedupe_within:
        events = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark(
            "event_time", dedupe_within).dropDuplicatesWithinWatermark(["uniqueid", "dtc_code", "ts"]).drop("event_time")
    return events


def stream_episodes(events: DataFrame, gap: int, delay: str) -> DataFrame:
    """Gap-only episodes, emitted once the watermark has passed their gap.

    A row may arrive up to ``delay`` behind the newest one; later it is dropped.

    An engine cycle may arrive late and split an episode that is already out;
    the batch rebuild decides then.
    """
    timed = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    session = F.session_window("event_time", f"{int(gap)} seconds")
    return timed.groupBy("uniqueid", "dtc_code", session.alias("s")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("occurrences"),
    ).select("uniqueid", "dtc_code", "first_ts", "last_ts", "occurrences",
             (F.col("last_ts") - F.col("first_ts")).alias("persistence_sec"))


def stream_daily_trend(events: DataFrame, delay: str) -> DataFrame:
    """Events per tenant and day, emitted when the day is closed and ``delay`` has passed."""
    timed = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return timed.groupBy("clientLoginId", F.window("event_time", "1 day").alias("w")).agg(
        F.count("*").alias("events")).select("clientLoginId", F.to_date("w.start").alias("date"), "events")


def stream_latest_state(events: DataFrame) -> DataFrame:
    """Last event second and event count per vehicle and code (update mode)."""
    return events.groupBy("uniqueid", "dtc_code").agg(
        F.max("ts").alias("last_dtc_ts"), F.count("*").alias("events"))


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run an append-mode stream into a parquet folder."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


COMPACT_EVERY = 20


def keep_latest_in(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True, keys: tuple[str, ...] = ("uniqueid", "dtc_code"),
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Run an update-mode stream into a table of versions; read it with ``latest_state``.

    Every batch's changed rows are stored under their batch number, which makes
    a repeated batch harmless. Each ``compact_every`` batches the newest row of
    every key up to there becomes one version, ``compacted=n``; a reader takes
    the last one and the batches after it, so the folders read stay bounded.
    Older folders are nobody's input any more and may be removed at any time.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = latest_state(read_state(batch.sparkSession, path, batch_id), keys)
            whole.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/compacted={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


STATE_KEYS = "uniqueid string, dtc_code string, last_dtc_ts long, events long, batch_id int"


def read_state(spark: SparkSession, path: str, upto: int | None = None, schema: str | T.StructType = STATE_KEYS) -> DataFrame:
    """The last compacted version (before batch ``upto``, if given) and the batches after it.

    Before the first batch this is an empty table of ``schema``.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    done: dict[str, list[int]] = {"batch_id": [], "compacted": []}
    for n in names:
        kind, _, number = n.partition("=")
        # a version without its marker is still being written
        if kind in done and number.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")):
            done[kind].append(int(number))
    base = max((n for n in done["compacted"] if upto is None or n < upto), default=-1)
    parts = [spark.read.parquet(f"{path}/batch_id={n}").withColumn("batch_id", F.lit(n)) for n in sorted(done["batch_id"]) if n > base]
    if base >= 0:
        parts.append(spark.read.parquet(f"{path}/compacted={base}"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def latest_state(stored: DataFrame, keys: tuple[str, ...] = ("uniqueid", "dtc_code")) -> DataFrame:
    """The newest stored row per key."""
    rest = [c for c in stored.columns if c not in (*keys, "batch_id")]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
