"""Roll-ups that are brought forward with the fault table."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from faultloom import schemas
from faultloom.operators import rollups
from faultloom.operators.events import events_exploded
from faultloom.operators.fault_master import vehicle_fault_master
from faultloom.params import Params
from faultloom.plans import incremental, upkeep
from faultloom.sources import readers


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def sec(n):
    return int((day(n) - datetime(1970, 1, 1)).total_seconds())


def params(n, **other):
    return Params(as_of=sec(n), **other)


def master(spark, rows):
    return spark.createDataFrame(
        [(t, v, v, c, "m", 2000, "t", "obd_solution", 0.0) for v, t, c in rows],
        "clientLoginId string, uniqueid string, vehicle_number string, customer_name string, model string, manufacturing_year int, vehicle_type string, solutionType string, tank_capacity double")


def codes(spark, severity=1, action="look"):
    return readers.build_dtc_master(spark.createDataFrame(
        [(f"P{i}", "Engine", severity if i == 2 else 3, action if i == 3 else "fix") for i in range(1, 6)],
        "dtc_code string, system string, severity_level int, action_required string"))


def history(spark, rows):
    return spark.createDataFrame([(v, day(n), list(c), 0.0, 0.0, None) for v, n, c in rows], schemas.DTC_HISTORY)


def cycles(spark, rows):
    return spark.createDataFrame([(v, sec(n)) for v, n in rows], "uniqueid string, cycle_ts long")


def values(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns
            for name in upkeep.ROLLUPS for d, _, fs in os.walk(f"{folder}/{name}") for f in fs if f.endswith(".parquet")}


def assert_as_built(got, run, vm, dm, p):
    """The kept tables against those of a fault table built whole."""
    said, moved = run
    vfm = vehicle_fault_master(events_exploded(said, vm, p), moved, vm, dm, p).cache()
    stats = rollups.vehicle_code_stats(vfm, p).cache()
    want = {
        "vehicle_code_stats": stats, "fleet_dtc_distribution": rollups.fleet_dtc_distribution(stats),
        "dtc_fleet_impact": rollups.dtc_fleet_impact(stats), "fleet_system_health": rollups.fleet_system_health(stats),
        "fleet_health_summary": rollups.fleet_health_summary(stats, vm, p), "fleet_fault_trends": rollups.fleet_fault_trends(vfm, p),
        "dtc_cooccurrence": rollups.dtc_cooccurrence(stats), "maintenance_priority": rollups.maintenance_priority(vfm, stats, dm),
        "vehicle_health_summary": rollups.vehicle_health_summary(stats, vm, p),
    }
    assert set(want) == set(got)
    for name in want:
        assert values(got[name]) == values(want[name]), name


FIRST = [("A", 5, ["P1", "P2"]), ("A", 40, ["P1"]), ("B", 41, ["P1", "P2"]), ("C", 42, ["P3", "P4"]), ("D", 43, ["P3", "P4"]),
         ("E", 62, ["P5"]), ("F", 50, ["P5", "P1"])]
MASTER = [("A", "T1", "C"), ("B", "T1", "C"), ("C", "T2", "C"), ("D", "T2", "C"), ("E", "T3", "C"), ("F", "T3", "C"), ("quiet", "T4", "C")]
MOVES = [("A", 10), ("B", 44), ("C", 45)]


def test_two_runs_equal_a_full_build_and_leave_other_files(spark, tmp_path):
    folder = f"{tmp_path}/kept"
    vm, dm = master(spark, MASTER), codes(spark)
    incremental.run_rollups(spark, folder, history(spark, FIRST), cycles(spark, MOVES), vm, dm, params(70))
    before = files(folder)
    later = [*FIRST, ("E", 70, ["P5"])]
    got = incremental.run_rollups(spark, folder, history(spark, later), cycles(spark, MOVES), vm, dm, params(71))
    assert_as_built(got, (history(spark, later), cycles(spark, MOVES)), vm, dm, params(71))
    after = files(folder)
    rewritten = {os.path.dirname(f) for f in {*before, *after} if before.get(f) != after.get(f)}
    # E has news and A's second episode leaves the last 30 days; the others and all days but one keep their files
    bucket = upkeep.bucketed(64)["vehicle_code_stats"].partition_expr
    expected = {r[0] for r in spark.createDataFrame([("A",), ("E",)], "uniqueid string").select(bucket).collect()}
    assert {d for d in rewritten if d.startswith("vehicle_code_stats/")} == {f"vehicle_code_stats/bucket={b}" for b in expected}
    assert {d for d in rewritten if d.startswith("fleet_fault_trends/")} == {"fleet_fault_trends/event_month=202403"}
    # nothing new at the same time: no file is written
    incremental.run_rollups(spark, folder, history(spark, later), cycles(spark, MOVES), vm, dm, params(71))
    assert files(folder) == after


def test_changed_masters_moved_vehicles_and_gone_ones(spark, tmp_path):
    folder = f"{tmp_path}/kept"
    said, moved = history(spark, FIRST), cycles(spark, MOVES)
    incremental.run_rollups(spark, folder, said, moved, master(spark, MASTER), codes(spark), params(70), buckets=3)
    # B changes tenant, D goes with its pair, quiet's tenant goes, a new one comes; P2 is severe now, P3 has another action
    vm = master(spark, [("A", "T1", "renamed"), ("B", "T9", "C"), ("C", "T2", "C"), ("E", "T3", "C"), ("F", "T3", "C"), ("new", "T8", "C")])
    dm = codes(spark, severity=4, action="replace")
    got = incremental.run_rollups(spark, folder, said, moved, vm, dm, params(70), buckets=3)
    assert_as_built(got, (said, moved), vm, dm, params(70))
    assert {r.clientLoginId for r in got["fleet_health_summary"].collect()} == {"T1", "T2", "T3", "T8", "T9"}


def test_borders_of_the_last_days_and_of_the_window(spark, tmp_path):
    """No new row at all: run times from days later to months later, past the analysed window."""
    folder, vm, dm = f"{tmp_path}/kept", master(spark, MASTER), codes(spark)
    run = history(spark, FIRST), cycles(spark, [])
    incremental.run_rollups(spark, folder, *run, vm, dm, params(63))
    for n in (93, 200):
        got = incremental.run_rollups(spark, folder, *run, vm, dm, params(n))
        assert_as_built(got, run, vm, dm, params(n))
    assert got["vehicle_code_stats"].isEmpty() and got["fleet_fault_trends"].isEmpty()
    assert got["vehicle_health_summary"].count() == len(MASTER)


@pytest.mark.parametrize("fails_at", ["fleet_fault_trends", "vehicle_code_stats"])
def test_a_call_that_fails_is_made_up_for(spark, tmp_path, monkeypatch, fails_at):
    folder, vm, dm = f"{tmp_path}/kept", master(spark, MASTER), codes(spark)
    incremental.run_rollups(spark, folder, history(spark, FIRST), cycles(spark, MOVES), vm, dm, params(70))
    whole = upkeep.replace_units

    def broken(path, *rest):
        if path.endswith(fails_at):
            raise RuntimeError("lost")
        whole(path, *rest)

    second = [*FIRST, ("B", 70, ["P2"]), ("F", 70, ["P3"])]
    monkeypatch.setattr(upkeep, "replace_units", broken)
    with pytest.raises(RuntimeError):
        incremental.run_rollups(spark, folder, history(spark, second), cycles(spark, MOVES), vm, dm, params(71))
    monkeypatch.setattr(upkeep, "replace_units", whole)
    third = [*second, ("A", 71, ["P4"])]
    got = incremental.run_rollups(spark, folder, history(spark, third), cycles(spark, MOVES), vm, dm, params(72))
    assert_as_built(got, (history(spark, third), cycles(spark, MOVES)), vm, dm, params(72))


def test_other_parameters_build_whole(spark, tmp_path):
    folder, vm, dm = f"{tmp_path}/kept", master(spark, MASTER), codes(spark)
    run = history(spark, FIRST), cycles(spark, MOVES)
    incremental.run_rollups(spark, folder, *run, vm, dm, params(70))
    vfm = spark.read.parquet(f"{folder}/vehicle_fault_master")
    got = upkeep.keep_rollups(spark, folder, vfm, vm, dm, params(70), buckets=5)
    assert_as_built(got, run, vm, dm, params(70))
