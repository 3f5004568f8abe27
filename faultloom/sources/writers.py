"""Sinks: partitioned tables, rebuilds, appends, schema evolution, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Layout:
    """Partition column (derived) and sort keys of a stored table."""

    partition: str | None = None
    partition_expr: Column | None = None
    sort: tuple[str, ...] = ()


def layouts() -> dict[str, Layout]:
    month = lambda c: F.date_format(c, "yyyyMM").cast("int")
    return {
        "dtc_events_exploded": Layout(
            "event_day", F.to_date(F.timestamp_seconds("ts")), ("clientLoginId", "uniqueid", "dtc_code", "ts")),
        "vehicle_fault_master": Layout(
            "event_month", month(F.col("event_date")), ("clientLoginId", "uniqueid", "dtc_code", "first_ts")),
        "fleet_fault_trends": Layout("event_month", month(F.col("date")), ("clientLoginId", "date")),
        # looked up by key: files hold ranges of it, so row-group statistics skip the rest
        "fleet_health_summary": Layout(sort=("clientLoginId",)),
        "fleet_dtc_distribution": Layout(sort=("clientLoginId", "dtc_code")),
        "fleet_system_health": Layout(sort=("clientLoginId", "system")),
        "vehicle_health_summary": Layout(sort=("uniqueid", "clientLoginId")),
        "dtc_fleet_impact": Layout(sort=("dtc_code", "clientLoginId")),
        "maintenance_priority": Layout(sort=("clientLoginId", "uniqueid", "dtc_code")),
        "dtc_cooccurrence": Layout(sort=("dtc_code_a", "dtc_code_b")),
        "vehicle_code_stats": Layout(sort=("uniqueid", "dtc_code")),
    }


def write_partitioned(df: DataFrame, path: str, layout: Layout | None = None, mode: str = "overwrite") -> None:
    """Write with the table's partition column and in-file sort order.

    ``rebalance`` lets adaptive execution split a partition value that holds
    most of the rows and merge small ones; a plain repartition by the value
    would put it all into one task.
    """
    layout = layout or Layout()
    if layout.partition:
        df = df.withColumn(layout.partition, layout.partition_expr).hint("rebalance", layout.partition)
        df = df.sortWithinPartitions(layout.partition, *layout.sort)
        df.write.mode(mode).partitionBy(layout.partition).parquet(path)
    else:
        # range-partitioned on the sort keys, so that a key lies in few files
        df = df.repartitionByRange(*layout.sort).sortWithinPartitions(*layout.sort) if layout.sort else df
        df.write.mode(mode).parquet(path)


def rebuild(df: DataFrame, path: str, layout: Layout | None = None, *, only_touched_partitions: bool = False) -> None:
    """Replace a table, or only the partitions that ``df`` has rows for.

    With ``only_touched_partitions`` the partition must hold all its rows in
    ``df``; without a partition column the whole table is replaced.
    """
    layout = layout or Layout()
    if not (only_touched_partitions and layout.partition):
        write_partitioned(df, path, layout)
        return
    df = df.withColumn(layout.partition, layout.partition_expr).hint("rebalance", layout.partition)
    (
        df.sortWithinPartitions(layout.partition, *layout.sort)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(layout.partition).parquet(path)
    )


def drop_partition(spark: SparkSession, path: str, column: str, value: object) -> None:
    """Remove one partition of a stored table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append(df: DataFrame, path: str, layout: Layout | None = None) -> None:
    write_partitioned(df, path, layout, mode="append")


def evolve_schema(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows in the target schema: absent columns are added with their default
    (or null), present ones are cast, additional ones are kept at the end."""
    defaults = defaults or {}
    cols = []
    for field in target.fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            value = F.coalesce(value, default) if field.name in defaults else value
        else:
            value = default
        cols.append(value.alias(field.name))
    known = set(target.fieldNames())
    return df.select(*cols, *[c for c in df.columns if c not in known])


def exists(spark, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def write_eval_report(summary: DataFrame, per_question: DataFrame, folder: str, metadata: dict[str, str]) -> None:
    """Report as two JSON datasets, the summary carrying the run metadata; the rows, which repeat every key and text, are packed."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())])
    summary.withColumn("version", meta).write.mode("overwrite").json(f"{folder}/summary")
    per_question.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/per_question")


def read_eval_report(spark, folder: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{folder}/per_question")


def union_evolved(old: DataFrame, new: DataFrame, sort: Sequence[str] = ()) -> DataFrame:
    """Old and new rows under the union of their columns."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.sortWithinPartitions(*sort) if sort else both
