"""History first, then the stream: each message once across the seam.

The backfill writes down which files it takes before it reads them; this list
is the seam. It reads exactly these files as one batch. The stream then reads
the same folder and leaves the listed files out, so a file that appeared while
the backfill ran, or holds messages older than others, is the stream's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultloom.operators.events import events_exploded
from faultloom.params import Params
from faultloom.sources import writers
from faultloom.streaming.streams import append_to

_SEAM = "file string"


def _there(spark: SparkSession, source: str, schema: T.StructType) -> DataFrame:
    """The rows there now, each with its file."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"))


def seam(spark: SparkSession, target: str) -> DataFrame:
    """The files that the backfill of ``target`` has taken; none before a backfill."""
    path = f"{target}/seam"
    return spark.read.schema(_SEAM).parquet(path) if writers.exists(spark, path) else spark.createDataFrame([], _SEAM)


def backfill_events(
    spark: SparkSession, source: str, schema: T.StructType, vehicles: DataFrame, target: str, params: Params | None = None,
) -> None:
    """All events of the files that ``source`` holds at the first call.

    A backfill that failed is called again: it takes the files written down
    then, and replaces what it has written. An empty folder gives an empty
    backfill.
    """
    there = _there(spark, source, schema)
    if not writers.exists(spark, f"{target}/seam"):
        # a name a file; a file without rows has nothing to take
        there.select(F.col("_file").alias("file")).distinct().write.mode("overwrite").parquet(f"{target}/seam")
    history = there.join(seam(spark, target).withColumnRenamed("file", "_file"), "_file", "left_semi").drop("_file")
    writers.write_partitioned(events_exploded(history, vehicles, params), f"{target}/backfill", writers.layouts()["dtc_events_exploded"])


def stream_after_backfill(
    spark: SparkSession, source: str, schema: T.StructType, target: str, files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of the messages whose files the backfill of ``target`` has not taken."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arriving = reader.parquet(source).select("*", F.col("_metadata.file_path").alias("_file"))
    taken = seam(spark, target).withColumnRenamed("file", "_file")
    return arriving.join(taken, "_file", "left_anti").drop("_file")


def continue_events(
    spark: SparkSession, source: str, schema: T.StructType, vehicles: DataFrame, target: str, params: Params | None = None, available_now: bool = True,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """The stream that goes on where the backfill ended; its checkpoint lies with the table, so a restart goes on too."""
    arriving = stream_after_backfill(spark, source, schema, target, files_per_trigger)
    return append_to(events_exploded(arriving, vehicles, params), f"{target}/live", f"{target}/checkpoint", available_now)


def continuous_events(spark: SparkSession, target: str) -> DataFrame:
    """Backfilled and streamed events as one table."""
    parts = [spark.read.parquet(f"{target}/{p}") for p in ("backfill", "live") if writers.exists(spark, f"{target}/{p}")]
    if not parts:
        raise ValueError(f"no events under {target}")
    parts = [p.select(*[c for c in p.columns if c != "event_day"]) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
