"""Fault episodes: runs of events of one vehicle and code, ended by silence or
by an engine cycle.

An engine cycle falls between two consecutive events exactly when the last
cycle at or before them differs. Every event therefore first learns its
``last_cycle`` (an as-of lookup per vehicle), and an episode is a gap session
inside one value of ``last_cycle``.

Hot vehicles. One vehicle may own a large share of all messages, so no step
sorts raw events of a vehicle in one task:

1. events collapse to one row per vehicle, code and second with a count; the
   map side combines, and a code has at most 86,400 such rows a day;
2. the as-of lookup and the session break run inside (vehicle, time slice); the
   last cycle of earlier slices enters as one carry row per slice;
3. only the resulting slice sessions, usually a few per code and day, meet per
   vehicle and code, where sessions that touch across a slice border are joined.

All windows of step 3 share one partitioning by vehicle and code. Nothing sorts
or buffers all rows of a vehicle: what is known per vehicle (last cycle, risk,
master data) is aggregated with map-side combining and joined on the vehicle,
and adaptive execution splits a join partition that a hot vehicle fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.params import Params


def event_seconds(events: DataFrame) -> DataFrame:
    """(uniqueid, dtc_code, ts) with the number of events in that second."""
    return events.groupBy("uniqueid", "dtc_code", "ts").agg(F.count("*").alias("n"))


def cycle_seconds(cycles: DataFrame) -> DataFrame:
    """(uniqueid, cycle_ts) with the number of cycle rows in that second."""
    return cycles.groupBy("uniqueid", "cycle_ts").agg(F.count("*").alias("cycles"))


def previous_event(events: DataFrame) -> DataFrame:
    """Previous second of the same vehicle and code; 0 marks the first.

    The lookup stays inside a day where it can: each day needs the last second
    of the day before it with events, one row per vehicle, code and day.
    """
    seconds = event_seconds(events).withColumn("slice", F.floor(F.col("ts") / 86400))
    last = seconds.groupBy("uniqueid", "dtc_code", "slice").agg(F.max("ts").alias("slice_last"))
    by_slice = Window.partitionBy("uniqueid", "dtc_code").orderBy("slice")
    carried = last.select(
        "uniqueid", "dtc_code", "slice", F.lag("slice_last", 1, 0).over(by_slice).alias("carried"))
    inside = Window.partitionBy("uniqueid", "dtc_code", "slice").orderBy("ts")
    return seconds.join(carried, ["uniqueid", "dtc_code", "slice"]).select(
        "uniqueid", "dtc_code", "ts", "n",
        F.coalesce(F.lag("ts").over(inside), F.col("carried")).alias("prev_ts"),
    )


def _carry_rows(cycles: DataFrame, slice_len: int, last_slice: Column) -> DataFrame:
    """For every slice after a cycle, up to the next slice with cycles, the
    last cycle before that slice."""
    per_slice = (
        cycles.withColumn("slice", F.floor(F.col("cycle_ts") / slice_len))
        .groupBy("uniqueid", "slice").agg(F.max(F.struct("cycle_ts", "cycles")).alias("c"))
    )
    nxt = F.lead("slice").over(Window.partitionBy("uniqueid").orderBy("slice"))
    spans = per_slice.withColumn("until", F.coalesce(nxt, last_slice)).filter("until > slice")
    return spans.select(
        "uniqueid", F.explode(F.sequence(F.col("slice") + 1, F.col("until"))).alias("slice"),
        F.col("c.cycle_ts").alias("cycle_ts"), F.col("c.cycles").alias("cycles"),
    )


def with_last_cycle(seconds: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """Add ``last_cycle`` (latest cycle at or before ts, null if none in the
    window) and ``cycles_at`` (cycle rows exactly at ts).

    Cycles up to the window start change nothing: all events lie after them.
    """
    n = params.chunk_seconds
    inside = cycle_seconds(cycles.filter(
        (F.col("cycle_ts") > params.since_ts) & (F.col("cycle_ts") <= params.as_of)))
    carry = _carry_rows(inside, n, F.lit(params.as_of // n).cast("long"))
    nul = F.lit(None)
    as_rows = lambda df, ts, slc, kind: df.select(
        "uniqueid", slc.cast("long").alias("slice"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"),
        nul.cast("string").alias("dtc_code"), nul.cast("long").alias("n"),
        F.col("cycle_ts").cast("long").alias("cycle_ts"), F.col("cycles").cast("long").alias("cycles"))
    both = (
        seconds.select(
            "uniqueid", F.floor(F.col("ts") / n).cast("long").alias("slice"), F.col("ts").cast("long").alias("ts"),
            F.lit(2).alias("kind"), "dtc_code", F.col("n").cast("long").alias("n"),
            nul.cast("long").alias("cycle_ts"), nul.cast("long").alias("cycles"))
        .unionByName(as_rows(inside, F.col("cycle_ts"), F.floor(F.col("cycle_ts") / n), 1))
        .unionByName(as_rows(carry, F.col("slice") * n, F.col("slice"), 0))
    )
    # at equal seconds a cycle sorts before the events, a carried one before both
    upto = (
        Window.partitionBy("uniqueid", "slice").orderBy("ts", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    looked_up = both.select(
        "uniqueid", "slice", "ts", "kind", "dtc_code", "n",
        F.last("cycle_ts", ignorenulls=True).over(upto).alias("last_cycle"),
        F.last("cycles", ignorenulls=True).over(upto).alias("_m"),
    )
    return looked_up.filter("kind = 2").select(
        "uniqueid", "slice", "dtc_code", "ts", "n", "last_cycle",
        F.when(F.col("last_cycle") == F.col("ts"), F.col("_m")).otherwise(F.lit(0)).cast("long").alias("cycles_at"),
    )


def break_flag(prev_ts: Column, ts: Column, gap: int, boundary: Column) -> Column:
    """1 where a new episode starts. ``prev_ts`` null or 0 marks a first event."""
    first = F.coalesce(prev_ts, F.lit(0)) == 0
    return F.when(first | (ts - prev_ts > gap) | boundary, 1).otherwise(0)


def slice_sessions(looked_up: DataFrame, gap: int) -> DataFrame:
    """Sessions inside one slice. Runs on the partitioning of the lookup."""
    w = Window.partitionBy("uniqueid", "slice", "dtc_code").orderBy("ts")
    boundary = ~F.col("last_cycle").eqNullSafe(F.lag("last_cycle").over(w))
    flagged = looked_up.withColumn("brk", break_flag(F.lag("ts").over(w), F.col("ts"), gap, boundary))
    numbered = flagged.withColumn("part", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("uniqueid", "slice", "dtc_code", "part").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("n").alias("n"),
        F.max("last_cycle").alias("last_cycle"), F.max("cycles_at").alias("cycles_at"),
    )


def episode_agg(seconds: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """One row per episode: number, first and last second, event count.

    ``engine_cycles_during`` comes for free: a cycle after the first second
    would have ended the episode, so only cycles exactly at it remain.
    """
    parts = slice_sessions(with_last_cycle(seconds, cycles, params), params.gap)
    w = Window.partitionBy("uniqueid", "dtc_code").orderBy("first_ts")
    boundary = ~F.col("last_cycle").eqNullSafe(F.lag("last_cycle").over(w))
    flagged = parts.withColumn("brk", break_flag(F.lag("last_ts").over(w), F.col("first_ts"), params.gap, boundary))
    numbered = flagged.withColumn("episode_no", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("uniqueid", "dtc_code", "episode_no").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("occurrence_count"), F.max("cycles_at").alias("engine_cycles_during"),
    )


def number_event_seconds(seconds: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """Every event second with its boundary, break flag and episode number:
    the event-level view of the episodes, for drill-down."""
    looked_up = with_last_cycle(seconds, cycles, params)
    w = Window.partitionBy("uniqueid", "slice", "dtc_code").orderBy("ts")
    edge = looked_up.groupBy("uniqueid", "dtc_code", "slice").agg(
        F.max(F.struct("ts", "last_cycle")).alias("e"))
    by_slice = Window.partitionBy("uniqueid", "dtc_code").orderBy("slice")
    carried = edge.select("uniqueid", "dtc_code", "slice", F.lag("e").over(by_slice).alias("before"))
    here = F.lag(F.struct("ts", "last_cycle")).over(w)
    flagged = (
        looked_up.join(carried, ["uniqueid", "dtc_code", "slice"])
        .withColumn("prev", F.coalesce(here, F.col("before")))
        .withColumn("prev_ts", F.coalesce(F.col("prev.ts"), F.lit(0)))
        .withColumn("has_boundary", F.when(
            F.col("prev").isNotNull() & ~F.col("last_cycle").eqNullSafe(F.col("prev.last_cycle")), 1).otherwise(0))
        .withColumn("is_break", break_flag(
            F.col("prev.ts"), F.col("ts"), params.gap, F.col("has_boundary") == 1))
    )
    sizes = flagged.groupBy("uniqueid", "dtc_code", "slice").agg(F.sum("is_break").alias("b"))
    earlier = sizes.select(
        "uniqueid", "dtc_code", "slice",
        F.coalesce(F.sum("b").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    running = F.sum("is_break").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(earlier, ["uniqueid", "dtc_code", "slice"]).select(
        "uniqueid", "dtc_code", "ts", "n", "prev_ts", "has_boundary", "is_break",
        (running + F.col("earlier")).alias("episode_no"))


def last_engine_cycle(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("uniqueid").agg(F.max("cycle_ts").alias("max_cycle_ts"))


def resolution(episodes: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """Resolved when quiet since the cutoff and the engine ran afterwards."""
    joined = episodes.join(last_engine_cycle(cycles), "uniqueid", "left")
    done = (F.col("last_ts") <= params.cutoff_ts) & (F.coalesce("max_cycle_ts", F.lit(0)) > F.col("last_ts"))
    return joined.select(
        *episodes.columns,
        F.greatest(F.lit(0), F.col("last_ts") - F.col("first_ts")).alias("resolution_time_sec"),
        F.when(done, 1).otherwise(0).alias("is_resolved"),
    )


def gap_from_previous_episode(episodes: DataFrame) -> DataFrame:
    before = F.lag("last_ts").over(Window.partitionBy("uniqueid", "dtc_code").orderBy("first_ts"))
    return episodes.withColumn(
        "gap_from_previous_episode", F.coalesce(F.greatest(F.lit(0), F.col("first_ts") - before), F.lit(0)))


def episode_counts(episodes: DataFrame) -> DataFrame:
    """Episodes per vehicle and code."""
    return episodes.groupBy("uniqueid", "dtc_code").agg(F.count("*").alias("ep_count"))


def resolved_episodes(events: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """Episodes with resolution, distance to the previous one and recurrence count."""
    # as many as stand before and after: both numbers run along the sorted rows, and no group is held as a whole
    by = Window.partitionBy("uniqueid", "dtc_code")
    numbered = F.row_number().over(by.orderBy("first_ts")) + F.row_number().over(by.orderBy(F.desc("first_ts"))) - 1
    episodes = gap_from_previous_episode(episode_agg(event_seconds(events), cycles, params)).withColumn("ep_count", numbered.cast("long"))
    return resolution(episodes, cycles, params)


def engine_cycles_during(episodes: DataFrame, cycles: DataFrame, params: Params) -> DataFrame:
    """Cycles inside ``[first_ts, last_ts]`` for intervals of any origin: the
    running cycle count at the end minus the one before the start."""
    n = params.chunk_seconds
    counted = cycle_seconds(cycles).withColumn("slice", F.floor(F.col("cycle_ts") / n).cast("long"))
    probes = (
        episodes.select("uniqueid", F.explode(F.array(F.col("first_ts") - 1, F.col("last_ts"))).alias("ts")).distinct()
        .withColumn("slice", F.floor(F.col("ts") / n).cast("long"))
    )
    # cycles of earlier slices, one row per vehicle and slice that either side has
    totals = (
        counted.groupBy("uniqueid", "slice").agg(F.sum("cycles").alias("c"))
        .unionByName(probes.select("uniqueid", "slice", F.lit(0).cast("long").alias("c")).distinct())
        .groupBy("uniqueid", "slice").agg(F.sum("c").alias("c"))
    )
    before = Window.partitionBy("uniqueid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("uniqueid", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    rows = probes.select("uniqueid", "slice", "ts", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("c")).unionByName(
        counted.select("uniqueid", "slice", F.col("cycle_ts").alias("ts"), F.lit(0).alias("kind"), F.col("cycles").alias("c")))
    upto = (
        Window.partitionBy("uniqueid", "slice").orderBy("ts", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at = (
        rows.withColumn("upto", F.sum("c").over(upto)).filter("kind = 1")
        .join(base, ["uniqueid", "slice"])
        .select("uniqueid", F.col("ts").alias("probe_ts"), (F.col("upto") + F.col("base")).alias("cycles_upto"))
    )
    start = at.select("uniqueid", (F.col("probe_ts") + 1).alias("first_ts"), F.col("cycles_upto").alias("_a"))
    end = at.select("uniqueid", F.col("probe_ts").alias("last_ts"), F.col("cycles_upto").alias("_b"))
    keep = [c for c in episodes.columns if c != "engine_cycles_during"]
    return (
        episodes.select(*keep).join(start, ["uniqueid", "first_ts"]).join(end, ["uniqueid", "last_ts"])
        .select(*keep, (F.col("_b") - F.col("_a")).alias("engine_cycles_during"))
    )
