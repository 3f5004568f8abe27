"""Episodes that an engine cycle ends, while messages and cycles arrive.

Messages and cycles are one stream, keyed by vehicle. Rows wait in keyed state
until the watermark has passed them, so they are taken in order however they
arrive; an event-time timer wakes the vehicle. A cycle ends the open episodes
of all its codes, a message after a longer gap ends its own, and an episode
that no message can extend any more is given out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from faultloom.params import Params
from faultloom.sources.readers import epoch_seconds
from faultloom.streaming.streams import append_to

EPISODE = "uniqueid string, dtc_code string, first_ts long, last_ts long, occurrence_count long, engine_cycles_during long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _summed(rows: Iterable[tuple]) -> list[tuple[int, int, str, int]]:
    """(ts, kind, dtc_code, n) in order, equal places as one."""
    sums: dict[tuple[int, int, str], int] = {}
    for ts, kind, code, n in rows:
        place = int(ts), int(kind), code
        sums[place] = sums.get(place, 0) + int(n)
    return [(*place, sums[place]) for place in sorted(sums)]


class EpisodeCloser(StatefulProcessor):
    """Per vehicle: rows the watermark has not passed, open episodes by code, the last cycle.

    What is held is bounded by the rows within the delay and by the codes with
    an open episode; a vehicle without either keeps its last cycle only.
    """

    def __init__(self, gap: int):
        self.gap = int(gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # lists go to and from the store whole: one call a vehicle, not one a row
        # kind 0 is a cycle, 1 a message: at equal seconds the cycle comes first
        self.waiting = handle.getListState("waiting", "ts long, kind int, dtc_code string, n long")
        self.open = handle.getListState("open", "dtc_code string, first_ts long, last_ts long, n long, cycles long")
        self.cycle = handle.getValueState("cycle", "ts long, n long")
        # seconds up to which all rows were taken, and when the timer rings
        self.clock = handle.getValueState("clock", "done long, timer long")

    def _clock(self) -> tuple[int, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (-1, -1)

    def _ring(self, at: int | None, done: int, before: int) -> None:
        """One timer a vehicle; it rings when the watermark is past second ``at``."""
        at = -1 if at is None else at
        if at != before:
            if before >= 0:
                self.handle.deleteTimer(before * 1000 + 1)
            if at >= 0:
                self.handle.registerTimer(at * 1000 + 1)
        self.clock.update((done, at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, timer = self._clock()
        came = _summed(
            place for part in rows for place in zip(*(part[c].tolist() for c in ("ts", "kind", "dtc_code", "n")), strict=True)
            if place[0] > done and isinstance(place[2], str))
        if came:
            self.waiting.appendList(came)
            first = came[0][0]
            if timer < 0 or first < timer:
                self._ring(first, done, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, timer = self._clock()
        # a row of a second before the watermark's cannot come any more
        done = (timerValues.getCurrentWatermarkInMs() - 1) // 1000
        open_ = {code: values for code, *values in self.open.get()}
        held = len(open_)
        cycle = tuple(self.cycle.get()) if self.cycle.exists() else (-1, 0)
        waiting = _summed(self.waiting.get())
        passed = bisect_right(waiting, done, key=itemgetter(0))
        later = waiting[passed:]
        out = []
        close = lambda code: out.append((key[0], code, *open_.pop(code)))
        for ts, kind, code, n in waiting[:passed]:
            if kind == 0:
                cycle = ts, n
                for c in list(open_):
                    close(c)
                continue
            if code in open_ and ts - open_[code][1] > self.gap:
                close(code)
            if code in open_:
                open_[code][1], open_[code][2] = ts, open_[code][2] + n
            else:
                open_[code] = [ts, ts, n, cycle[1] if cycle[0] == ts else 0]
        for c in [c for c, e in open_.items() if e[1] + self.gap <= done]:
            close(c)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if open_:
            self.open.put([(c, *e) for c, e in open_.items()])
        elif held:
            self.open.clear()
        if cycle[0] >= 0:
            self.cycle.update(cycle)
        next_ = [place[0] for place in later[:1]] + [e[1] + self.gap for e in open_.values()]
        # the timer that rang is gone
        self._ring(min(next_) if next_ else None, done, -1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])


def vehicle_rows(events: DataFrame, cycles: DataFrame) -> DataFrame:
    """Messages and cycles (``uniqueid``, ``cycle_ts``) as one stream of (uniqueid, ts, kind, dtc_code, n). Rows without a vehicle or a time go."""
    both = events.select("uniqueid", F.col("ts").cast("long").alias("ts"), F.lit(1).alias("kind"), "dtc_code").unionByName(
        cycles.select(F.col("uniqueid").cast("string").alias("uniqueid"), F.col("cycle_ts").cast("long").alias("ts"), F.lit(0).alias("kind"), F.lit("").alias("dtc_code")))
    return both.filter("uniqueid IS NOT NULL AND ts IS NOT NULL").select(
        "uniqueid", "ts", "kind", "dtc_code", F.lit(1).cast("long").alias("n"), F.timestamp_seconds("ts").alias("event_time"))


def stream_engine_episodes(events: DataFrame, cycles: DataFrame, params: Params, delay: str) -> DataFrame:
    """Closed episodes: uniqueid, dtc_code, first_ts, last_ts, occurrence_count, engine_cycles_during.

    They equal the batch episodes for everything the watermark has passed. A
    row may arrive up to ``delay`` behind the newest message or cycle; later it
    is dropped. An episode still open when the stream ends waits in the state
    for the next run.
    """
    timed = vehicle_rows(events, cycles).withWatermark("event_time", delay)
    return timed.groupBy("uniqueid").transformWithStateInPandas(
        EpisodeCloser(params.gap), outputStructType=EPISODE, outputMode="Append", timeMode="EventTime")


def append_keyed(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``append_to`` with the state store that keyed state needs; other queries of the session keep theirs."""
    conf = df.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return append_to(df, path, checkpoint, available_now)
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def stream_resolution(episodes: DataFrame, cycles: DataFrame, delay: str, within_seconds: int) -> DataFrame:
    """Closed episodes with ``is_resolved``: 1 if an engine cycle follows the last second within ``within_seconds``, else 0.

    A left outer join on the vehicle and a time range. A resolved episode comes
    out with its first cycle to arrive, an unresolved one when the watermark of
    both streams is past its range; either comes out once.
    """
    closed = episodes.withColumn("closed_at", F.timestamp_seconds("last_ts")).withWatermark("closed_at", delay)
    ran = cycles.filter("uniqueid IS NOT NULL AND cycle_ts IS NOT NULL").select(
        F.col("uniqueid").cast("string").alias("ran"), F.timestamp_seconds(F.col("cycle_ts").cast("long")).alias("ran_at")).withWatermark("ran_at", delay)
    follows = (F.col("uniqueid") == F.col("ran")) & (F.col("ran_at") > F.col("closed_at")) & (
        F.col("ran_at") <= F.col("closed_at") + F.expr(f"INTERVAL {int(within_seconds)} SECONDS"))
    met = closed.join(ran, follows, "leftOuter").select(
        *episodes.columns, "closed_at", F.greatest(F.lit(0), F.col("last_ts") - F.col("first_ts")).alias("resolution_time_sec"),
        F.col("ran").isNotNull().cast("int").alias("is_resolved"))
    return met.dropDuplicatesWithinWatermark(["uniqueid", "dtc_code", "first_ts"]).drop("closed_at")


def read_cycles(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of cycle ends from a folder, as ``uniqueid`` and ``cycle_ts`` in seconds."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(path).filter("cycle_end_ts IS NOT NULL")
    return raw.select("uniqueid", epoch_seconds(raw, "cycle_end_ts").alias("cycle_ts"))
