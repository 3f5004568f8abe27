from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from faultloom import schemas
from faultloom.operators import events
from faultloom.streaming import backfill as bf
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


@pytest.fixture
def place(spark, tmp_path):
    vm = spark.createDataFrame([("T", "V1", "n1"), ("T", "V2", "n2")], "clientLoginId string, uniqueid string, vehicle_number string")
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"

    def put(name, *messages):
        spark.createDataFrame([(u, T0 + timedelta(minutes=m), list(c), None, None, None) for u, m, *c in messages], schemas.DTC_HISTORY).coalesce(1).write.parquet(f"{source}/{name}")

    def run(**how):
        bf.continue_events(spark, source, schemas.DTC_HISTORY, vm, target, **how).awaitTermination()

    def whole():
        history = spark.read.schema(schemas.DTC_HISTORY).option("recursiveFileLookup", "true").parquet(source)
        return events.events_exploded(history, vm)

    return source, target, vm, put, run, whole


def same(a, b):
    return rows(a, *b.columns) == rows(b, *b.columns)


def test_each_message_once_across_the_seam(spark, place):
    source, target, vm, put, run, whole = place
    put("a", ("V1", 0, "P1", "P2"), ("V2", 5, "P1"), ("X", 5, "P1"))
    put("b", ("V1", 60, "P1", "0"), ("V1", 0, "P1"))
    bf.backfill_events(spark, source, schemas.DTC_HISTORY, vm, target)
    assert same(bf.continuous_events(spark, target), whole())
    # older than what the backfill has seen, and a delivery twice: both are messages of their own files
    put("c", ("V2", -600, "P9"), ("V1", 60, "P1"))
    run()
    assert same(bf.continuous_events(spark, target), whole())
    put("d", ("V2", 900, "P1"))
    run(files_per_trigger=1)
    run()
    assert same(bf.continuous_events(spark, target), whole())


def test_failed_backfill_is_repeated_on_the_same_files(spark, place, monkeypatch):
    source, target, vm, put, run, whole = place
    put("a", ("V1", 0, "P1"), ("V2", 5, "P1"))

    def fails(*_args, **_kw):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(bf.writers, "write_partitioned", fails)
        with pytest.raises(OSError):
            bf.backfill_events(spark, source, schemas.DTC_HISTORY, vm, target)
    # a file that comes between the two calls, and is streamed before the second
    put("b", ("V1", 60, "P1"))
    run()
    bf.backfill_events(spark, source, schemas.DTC_HISTORY, vm, target)
    bf.backfill_events(spark, source, schemas.DTC_HISTORY, vm, target)
    run()
    assert bf.seam(spark, target).count() == 1
    assert same(bf.continuous_events(spark, target), whole())


def test_without_backfill_the_stream_takes_all(spark, place):
    source, target, vm, put, run, whole = place
    put("a", ("V1", 0, "P1"))
    with pytest.raises(ValueError):
        bf.continuous_events(spark, target)
    assert bf.seam(spark, target).count() == 0
    run()
    assert same(bf.continuous_events(spark, target), whole())
