"""Row numbers without funnelling a large group through one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.session import cut_lineage


def number_within(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column | str], out: str = "rn",
) -> DataFrame:
    """1-based row number per ``keys`` in ``order``; rows with null keys or a null chunk are numbered like others.

    ``chunk`` must rise with ``order``, nulls first. Rows are numbered inside (keys, chunk);
    the offset of a chunk is the running count of the chunks before it, so the
    only per-key sort runs over one row per chunk.
    """
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*keys, "_chunk")]
    return (
        chunked.alias("r").join(offsets.alias("o"), reduce(and_, same)).select("r.*", "o._off")
        .withColumn(out, F.row_number().over(inside) + F.col("_off"))
        .drop("_chunk", "_off")
    )


def number_globally(keys: DataFrame, key: str, out: str = "rn") -> DataFrame:
    """1-based position of every distinct ``key`` in the global sort order.

    The keys are range-partitioned and checkpointed, so partition ids are
    fixed; each partition numbers its own rows and is shifted by the count of
    the partitions before it (one row per partition).
    """
    ranged = keys.repartitionByRange(F.col(key)).withColumn("_pid", F.spark_partition_id())
    fixed = cut_lineage(ranged)
    return number_within(fixed.withColumn("_all", F.lit(0)), ["_all"], F.col("_pid"), [key], out).drop("_all", "_pid")
