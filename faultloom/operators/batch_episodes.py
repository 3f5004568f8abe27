"""The batch variant: gap-only episodes, resolved by the next engine cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions.scoring import event_date
from faultloom.operators.episodes import (
    break_flag, cycle_seconds, event_seconds, last_engine_cycle, slice_sessions,
)
from faultloom.params import DAY


def usable_events(batch: DataFrame) -> DataFrame:
    """Rows whose ``ts`` reads as a number, as whole seconds."""
    number = F.col("ts").cast("string").try_cast("double")
    return batch.withColumn("ts", number).filter(
        F.col("ts").isNotNull() & ~F.isnan("ts")).withColumn("ts", F.col("ts").cast("long"))


def episodes_gap_only(batch: DataFrame, gap: int, chunk_seconds: int = DAY) -> DataFrame:
    """Episodes separated by silence only: sessions per time slice first, then
    the few slice sessions of a vehicle and code joined across slice borders."""
    seconds = event_seconds(usable_events(batch)).select(
        "*", F.floor(F.col("ts") / chunk_seconds).alias("slice"),
        F.lit(None).cast("long").alias("last_cycle"), F.lit(0).cast("long").alias("cycles_at"))
    parts = slice_sessions(seconds, gap)
    w = Window.partitionBy("uniqueid", "dtc_code").orderBy("first_ts")
    brk = break_flag(F.lag("last_ts").over(w), F.col("first_ts"), gap, F.lit(False))
    numbered = parts.withColumn("brk", brk).withColumn(
        "episode_no", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("uniqueid", "dtc_code", "episode_no").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("occurrences"),
    ).withColumn("persistence_sec", F.greatest(F.lit(0), F.col("last_ts") - F.col("first_ts")))


def deterministic_episode_id(uniqueid="uniqueid", code="dtc_code", first_ts="first_ts", number="episode_no"):
    """First 60 bits of the SHA-1 of the episode's identity."""
    seed = F.concat_ws("|", uniqueid, code, F.col(first_ts).cast("string"), F.col(number).cast("string"))
    return F.conv(F.substring(F.sha1(seed), 1, 15), 16, 10).cast("long")


def next_cycle_after(points: DataFrame, cycles: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """(uniqueid, ts, next_cycle): the first cycle strictly after each distinct point.

    A forward as-of lookup inside (vehicle, time slice); a slice without a
    later cycle of its own takes the first cycle of the slices after it.
    """
    slice_of = lambda c: F.floor(F.col(c) / chunk_seconds).cast("long")
    cyc = cycle_seconds(cycles).select("uniqueid", "cycle_ts", slice_of("cycle_ts").alias("slice"))
    pts = points.select("uniqueid", "ts").distinct().withColumn("slice", slice_of("ts"))
    firsts = (
        cyc.groupBy("uniqueid", "slice").agg(F.min("cycle_ts").alias("c"))
        .unionByName(pts.select("uniqueid", "slice", F.lit(None).cast("long").alias("c")).distinct())
        .groupBy("uniqueid", "slice").agg(F.min("c").alias("c"))
    )
    later = Window.partitionBy("uniqueid").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select("uniqueid", "slice", F.last("c", ignorenulls=True).over(later).alias("later_cycle"))
    rows = pts.select("uniqueid", "slice", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cycle_ts")).unionByName(
        cyc.select("uniqueid", "slice", F.col("cycle_ts").alias("ts"), F.lit(1).alias("kind"), "cycle_ts"))
    # walking backwards; at equal seconds the point comes first and does not see the cycle
    back = (
        Window.partitionBy("uniqueid", "slice").orderBy(F.desc("ts"), "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("own", F.last("cycle_ts", ignorenulls=True).over(back)).filter("kind = 0")
        .join(carried, ["uniqueid", "slice"])
        .select("uniqueid", "ts", F.coalesce("own", "later_cycle").alias("next_cycle"))
    )


def resolution_by_next_cycle(
    batch: DataFrame, cycles: DataFrame, gap: int, cutoff: int, chunk_seconds: int = DAY,
) -> DataFrame:
    """Gap-only episodes, resolved when a cycle follows before the next episode
    and the last event is not too recent for the batch."""
    episodes = episodes_gap_only(batch, gap, chunk_seconds)
    nxt = F.lead("first_ts").over(Window.partitionBy("uniqueid", "dtc_code").orderBy("first_ts"))
    with_next = episodes.withColumn("next_first", nxt)
    ends = next_cycle_after(episodes.select("uniqueid", F.col("last_ts").alias("ts")), cycles, chunk_seconds)
    newest = usable_events(batch).select(F.max("ts")).scalar()
    ambiguous = F.col("last_ts") > F.greatest(F.lit(0), newest - cutoff)
    found = F.col("next_cycle").isNotNull() & (
        F.col("next_first").isNull() | (F.col("next_cycle") < F.col("next_first")))
    return with_next.join(ends.withColumnRenamed("ts", "last_ts"), ["uniqueid", "last_ts"], "left").select(
        "uniqueid", "dtc_code", deterministic_episode_id().alias("episode_id"), "episode_no", "first_ts", "last_ts",
        "occurrences", "persistence_sec",
        F.when(found & ~ambiguous, 1).otherwise(0).alias("is_resolved"),
        F.when(ambiguous, "recent_window_ambiguous").when(found, "engine_cycle_no_reappearance")
        .otherwise("").alias("resolution_reason"),
        event_date("first_ts").alias("event_date"),
    )


def dtc_state(episodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Latest episode per vehicle and code, with the vehicle's last cycle."""
    last = F.max_by(F.struct("last_ts", "episode_id", "is_resolved"), F.col("episode_no"))
    state = episodes.groupBy("uniqueid", "dtc_code").agg(last.alias("e"))
    return state.join(last_engine_cycle(cycles), "uniqueid", "left").select(
        "uniqueid", "dtc_code", F.col("e.last_ts").alias("last_dtc_ts"),
        F.coalesce("max_cycle_ts", F.lit(0)).alias("last_engine_on_ts"),
        (1 - F.col("e.is_resolved")).alias("is_active"), F.col("e.episode_id").alias("last_episode_id"),
    )


def events_enriched(batch: DataFrame, ingestion_ts: int) -> DataFrame:
    """Event projection with null defaults."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return usable_events(batch).select(
        "uniqueid", "ts", F.timestamp_seconds("ts").alias("event_time"), "dtc_code", "dtc_pgn",
        F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lng", F.lit(0.0)).alias("lng"),
        text("code"), text("description"),
        F.coalesce(F.col("severity_level").cast("int"), F.lit(0)).alias("severity_level"),
        text("subsystem"), text("system"), F.timestamp_seconds(F.lit(ingestion_ts)).alias("ingestion_ts"),
    )
