from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from faultloom import Params, schemas
from faultloom.operators import episodes, events
from faultloom.streaming import engine_episodes as ee
from faultloom.streaming import streams
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
START = int(T0.timestamp())
PARAMS = Params(as_of=START + 40 * 86400, gap=1800)
CYCLES = "uniqueid string, cycle_end_ts timestamp"
COLS = ("uniqueid", "dtc_code", "first_ts", "last_ts", "occurrence_count", "engine_cycles_during")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def put(spark, folder, batches, schema):
    """One file a batch, in order of arrival."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/f{i:03d}")


def messages(parts):
    return [[(u, at(s), [c], None, None, None) for u, s, c in p] for p in parts]


def setup(spark, tmp, message_parts, cycle_parts):
    put(spark, f"{tmp}/m", messages(message_parts), schemas.DTC_HISTORY)
    put(spark, f"{tmp}/c", [[(u, at(s) if s is not None else None) for u, s in p] for p in cycle_parts], CYCLES)
    vm = spark.createDataFrame([("T", f"V{i}", f"n{i}") for i in range(9)], "clientLoginId string, uniqueid string, vehicle_number string")
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp}/{name}")
    live = streams.stream_events_exploded(stream("m", schemas.DTC_HISTORY), vm)
    return vm, live, ee.read_cycles(spark, f"{tmp}/c", CYCLES, 1)


def batch_episodes(spark, tmp, vm):
    exploded = events.events_exploded(spark.read.schema(schemas.DTC_HISTORY).option("recursiveFileLookup", "true").parquet(f"{tmp}/m"), vm)
    raw = spark.read.schema(CYCLES).option("recursiveFileLookup", "true").parquet(f"{tmp}/c")
    cycles = raw.filter("cycle_end_ts IS NOT NULL").selectExpr("uniqueid", "unix_timestamp(cycle_end_ts) AS cycle_ts")
    return episodes.episode_agg(episodes.event_seconds(exploded), cycles, PARAMS), cycles


FAR = ("far", 39 * 86400)


@pytest.mark.parametrize("shuffled", [False, True])
def test_closed_episodes_equal_batch(spark, tmp_path, shuffled):
    rng = random.Random(3 + shuffled)
    said = [(f"V{rng.randrange(3)}", rng.randrange(0, 86400, 300), rng.choice(["P1", "P2", "0"])) for _ in range(260)]
    ran = [(f"V{rng.randrange(3)}", rng.choice(said)[1] + rng.choice([0, 0, 7])) for _ in range(40)]
    said, ran = sorted(said, key=lambda r: r[1]), sorted(ran, key=lambda r: r[1])
    if shuffled:
        # out of order by up to two hours, inside the delay
        said = sorted(said, key=lambda r: r[1] + rng.randrange(7200))
        ran = sorted(ran, key=lambda r: r[1] + rng.randrange(7200))
    cut = lambda x, n: [x[i * len(x) // n: (i + 1) * len(x) // n] for i in range(n)]
    vm, live, cycles = setup(spark, tmp_path, cut(said, 3), [*cut(ran, 2), [FAR, ("V0", None), (None, 5)]])
    out = f"{tmp_path}/out"
    ee.append_keyed(ee.stream_engine_episodes(live, cycles, PARAMS, "24 hours"), out, f"{tmp_path}/cp").awaitTermination()
    want, _ = batch_episodes(spark, tmp_path, vm)
    assert rows(spark.read.parquet(out), *COLS) == rows(want, *COLS)


def test_open_episodes_wait_late_rows_go_and_a_restart_goes_on(spark, tmp_path):
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    run = lambda: ee.append_keyed(ee.stream_engine_episodes(live, cycles, PARAMS, "1 hour"), out, cp).awaitTermination()
    vm, live, cycles = setup(spark, tmp_path, [[("V1", 0, "P1"), ("V1", 600, "P1"), ("V2", 86000, "P1")]], [[("V1", 700), ("V3", 1)]])
    run()
    first = rows(spark.read.parquet(out), *COLS)
    # V2's message is newer than the watermark: held, with its state, for the next run
    assert first == [("V1", "P1", START, START + 600, 2, 0)]
    # behind the delay: dropped; inside the delay: extends what is still open; the cycle ends it
    more = [[("V1", 650, "P1"), ("V2", 85000, "P1")], [("V2", 87000, "P1"), ("V2", 87600, "P1")]]
    for i, b in enumerate(messages(more)):
        spark.createDataFrame(b, schemas.DTC_HISTORY).coalesce(1).write.parquet(f"{tmp_path}/m/g{i}")
    spark.createDataFrame([("V2", at(87300)), ("far", at(FAR[1]))], CYCLES).coalesce(1).write.parquet(f"{tmp_path}/c/g0")
    run()
    assert rows(spark.read.parquet(out), *COLS) == [
        ("V1", "P1", START, START + 600, 2, 0), ("V2", "P1", START + 85000, START + 87000, 3, 0), ("V2", "P1", START + 87600, START + 87600, 1, 0)]


def test_resolution_equals_batch(spark, tmp_path):
    within = 3 * 86400
    closed = [("V1", "P1", START, START + 600, 2, 0), ("V1", "P2", START + 50, START + 50, 1, 0), ("V2", "P1", START, START + 9, 1, 0), ("V3", "P1", START, START + 9, 1, 0)]
    spark.createDataFrame(closed, ee.EPISODE).coalesce(1).write.parquet(f"{tmp_path}/e/f0")
    # moves the watermark of the episodes
    spark.createDataFrame([("far", "P1", START + FAR[1], START + FAR[1], 1, 0)], ee.EPISODE).coalesce(1).write.parquet(f"{tmp_path}/e/f1")
    put(spark, f"{tmp_path}/c", [
        [("V1", at(600)), ("V1", at(601)), ("V1", at(9000)), ("V1", at(90_000))], [("V2", at(9 + within)), ("V3", at(10 + within)), (None, at(700)), FAR[:1] + (at(FAR[1]),)]], CYCLES)
    live = spark.readStream.schema(ee.EPISODE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/e")
    cycles = ee.read_cycles(spark, f"{tmp_path}/c", CYCLES, 1)
    streams.append_to(ee.stream_resolution(live, cycles, "1 hour", within), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out").filter("uniqueid <> 'far'"), "uniqueid", "dtc_code", "first_ts", "last_ts", "resolution_time_sec", "is_resolved")
    near = spark.createDataFrame([("V1", START + 600), ("V1", START + 601), ("V1", START + 90_000), ("V2", START + 9 + within)], "uniqueid string, cycle_ts long")
    want = episodes.resolution(spark.createDataFrame(closed, ee.EPISODE), near, PARAMS)
    assert got == rows(want, "uniqueid", "dtc_code", "first_ts", "last_ts", "resolution_time_sec", "is_resolved")
