from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultloom import schemas
from faultloom.operators import batch_episodes, events
from faultloom.streaming import streams
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def message(uid, minutes, *codes):
    return (uid, T0 + timedelta(minutes=minutes), list(codes), None, None, None)


@pytest.fixture
def source(spark, tmp_path):
    """Three files, delivered one per batch; the second repeats a message of the first."""
    files = [
        [message("V1", 0, "P1", "0"), message("V1", 10, "P1"), message("X", 0, "P1")],
        [message("V1", 10, "P1"), message("V1", 60, "P1", "P2"), message("V2", 61, "P1")],
        [message("V2", 60 * 24 * 3, "P9")],
    ]
    folder = tmp_path / "in"
    for i, rows_ in enumerate(files):
        spark.createDataFrame(rows_, schemas.DTC_HISTORY).coalesce(1).write.parquet(str(folder / f"f{i}"))
    vm = spark.createDataFrame([("T", "V1", "n1"), ("T", "V2", "n2")], "clientLoginId string, uniqueid string, vehicle_number string")
    batch = spark.read.schema(schemas.DTC_HISTORY).parquet(*[str(folder / f"f{i}") for i in range(3)])

    def stream():
        return spark.readStream.schema(schemas.DTC_HISTORY).option("maxFilesPerTrigger", 1).option(
            "recursiveFileLookup", "true").parquet(str(folder))

    return batch, stream, vm, tmp_path


def run(query_of, df, tmp_path):
    query = query_of(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def test_events_equal_batch(spark, source):
    batch, stream, vm, tmp = source
    out = run(streams.append_to, streams.stream_events_exploded(stream(), vm), tmp)
    want = events.events_exploded(batch, vm)
    assert rows(out, *want.columns) == rows(want, *want.columns)


def test_repeated_message_is_dropped(spark, source):
    batch, stream, vm, tmp = source
    out = run(streams.append_to, streams.stream_events_exploded(stream(), vm, dedupe_within="1 hour"), tmp)
    assert out.count() == events.events_exploded(batch, vm).count() - 1
    assert out.groupBy("uniqueid", "dtc_code", "ts").count().filter("count > 1").count() == 0


def test_closed_episodes_equal_batch(spark, source):
    batch, stream, vm, tmp = source
    live = streams.stream_episodes(streams.stream_events_exploded(stream(), vm), 1800, "2 hours")
    out = run(streams.append_to, live, tmp)
    want = batch_episodes.episodes_gap_only(events.events_exploded(batch, vm), 1800).filter("dtc_code <> 'P9'")
    cols = ("uniqueid", "dtc_code", "first_ts", "last_ts", "occurrences", "persistence_sec")
    assert rows(out, *cols) == rows(want, *cols)


def test_trend_and_state(spark, source):
    batch, stream, vm, tmp = source
    trend = run(streams.append_to, streams.stream_daily_trend(streams.stream_events_exploded(stream(), vm), "2 hours"), tmp / "a")
    assert [(str(r["date"]), r["events"]) for r in trend.collect()] == [("2024-01-01", 6)]
    stored = run(streams.keep_latest_in, streams.stream_latest_state(streams.stream_events_exploded(stream(), vm)), tmp / "b")
    assert stored.select("batch_id").distinct().count() >= 2
    want = events.events_exploded(batch, vm).groupBy("uniqueid", "dtc_code").agg(
        F.max("ts").alias("last_dtc_ts"), F.count("*").alias("events"))
    cols = ("uniqueid", "dtc_code", "last_dtc_ts", "events")
    assert rows(streams.latest_state(stored), *cols) == rows(want, *cols)


def test_state_is_compacted(spark, source):
    batch, stream, vm, tmp = source
    live = streams.stream_latest_state(streams.stream_events_exploded(stream(), vm))
    path = str(tmp / "out")
    streams.keep_latest_in(live, path, str(tmp / "cp"), compact_every=2).awaitTermination()
    assert (tmp / "out" / "compacted=1").exists()
    state = streams.read_state(spark, path)
    assert {r.batch_id for r in state.select("batch_id").distinct().collect()}.isdisjoint({0})
    want = events.events_exploded(batch, vm).groupBy("uniqueid", "dtc_code").agg(
        F.max("ts").alias("last_dtc_ts"), F.count("*").alias("events"))
    cols = ("uniqueid", "dtc_code", "last_dtc_ts", "events")
    assert rows(streams.latest_state(state), *cols) == rows(want, *cols)


@pytest.mark.parametrize("late,kept", [(30, True), (60 * 30, False)])
def test_late_rows(spark, tmp_path, late, kept):
    """A row behind the newest one counts inside the delay and is dropped beyond it."""
    # the watermark that drops late rows is that of the batch before
    for i, minutes in enumerate((60 * 48, 60 * 48 + 1, 60 * 48 - late, 60 * 24 * 9)):
        spark.createDataFrame([message("V1", minutes, "P1")], schemas.DTC_HISTORY).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    vm = spark.createDataFrame([("T", "V1", "n1")], "clientLoginId string, uniqueid string, vehicle_number string")
    stream = spark.readStream.schema(schemas.DTC_HISTORY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = run(streams.append_to, streams.stream_episodes(streams.stream_events_exploded(stream, vm), 600, "2 hours"), tmp_path)
    assert out.filter(f"first_ts = {int(T0.timestamp()) + 60 * (60 * 48 - late)}").count() == int(kept)


def test_state_before_the_first_batch_is_empty(spark, tmp_path):
    assert streams.read_state(spark, str(tmp_path / "never")).count() == 0
    (tmp_path / "begun" / "batch_id=0").mkdir(parents=True)
    state = streams.read_state(spark, str(tmp_path / "begun"))
    assert streams.latest_state(state).columns == ["uniqueid", "dtc_code", "last_dtc_ts", "events"] and state.count() == 0
