from __future__ import annotations

import random

import pytest

from faultloom import Params
from faultloom.functions import scoring
from faultloom.operators import batch_episodes, episodes, fault_master
from tests.conftest import rows

T0 = 1_700_000_000
EV = "uniqueid string, dtc_code string, ts long"
CY = "uniqueid string, cycle_ts long"


def params(**kw):
    return Params(**{"as_of": T0 + 40 * 86400, **kw})


def naive(events, cycles, gap):
    """Episodes by the definition: one pass per vehicle and code over seconds."""
    keyed, out = {}, []
    for uid, code, ts in events:
        keyed.setdefault((uid, code), {}).setdefault(ts, 0)
        keyed[uid, code][ts] += 1
    for (uid, code), seconds in keyed.items():
        prev, n, cur = None, 0, None
        for ts in sorted(seconds):
            cut = prev is not None and any(u == uid and prev < c <= ts for u, c in cycles)
            if prev is None or ts - prev > gap or cut:
                n += 1
                cur = [uid, code, n, ts, ts, 0]
                out.append(cur)
            cur[4], cur[5], prev = ts, cur[5] + seconds[ts], ts
    return [
        (*e, sum(1 for u, c in cycles if u == e[0] and e[3] <= c <= e[4])) for e in sorted(map(tuple, out))]


def engine(spark, events, cycles, p):
    ev = spark.createDataFrame(events, EV)
    cy = spark.createDataFrame(cycles, CY)
    return episodes.episode_agg(episodes.event_seconds(ev), cy, p), ev, cy


COLS = ("uniqueid", "dtc_code", "episode_no", "first_ts", "last_ts", "occurrence_count", "engine_cycles_during")


def random_case(seed):
    r = random.Random(seed)
    span = r.choice([3000, 90_000, 400_000])
    base = T0 - T0 % 86400 + r.choice([0, 43_200, 86_000])
    events = [(f"V{r.randrange(3)}", f"P{r.randrange(2)}", base + r.randrange(span)) for _ in range(r.randrange(1, 120))]
    events += r.sample(events, min(5, len(events)))
    cycles = [(f"V{r.randrange(4)}", base + r.randrange(span)) for _ in range(r.randrange(0, 25))]
    # cycles exactly at events, and some twice
    cycles += [(u, ts) for u, _, ts in r.sample(events, min(4, len(events)))] + cycles[:2]
    return events, cycles, r.choice([60, 1800, 20_000])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [3600, 86400])
def test_same_as_naive_definition(spark, seed, chunk):
    events, cycles, gap = random_case(seed)
    p = params(gap=gap, chunk_seconds=chunk)
    got, ev, cy = engine(spark, events, cycles, p)
    want = naive(events, cycles, gap)
    assert rows(got, *COLS) == want
    # the general interval count agrees with the one that comes for free
    assert rows(episodes.engine_cycles_during(got, cy, p), *COLS) == want
    # the event-level view has the same episodes
    numbered = episodes.number_event_seconds(episodes.event_seconds(ev), cy, p)
    per = numbered.groupBy("uniqueid", "dtc_code", "episode_no").agg({"n": "sum"})
    assert rows(per, "uniqueid", "dtc_code", "episode_no", "sum(n)") == [(e[0], e[1], e[2], e[5]) for e in want]


@pytest.mark.parametrize("seed", range(3))
def test_gap_only_same_as_naive(spark, seed):
    events, cycles, gap = random_case(seed)
    ev, cy = spark.createDataFrame(events, EV), spark.createDataFrame(cycles, CY)
    got = batch_episodes.episodes_gap_only(ev, gap)
    cols = ("uniqueid", "dtc_code", "episode_no", "first_ts", "last_ts", "occurrences")
    want = [e[:6] for e in naive(events, [], gap)]
    assert rows(got, *cols) == want
    # intervals that hold cycles
    during = episodes.engine_cycles_during(got.withColumnRenamed("occurrences", "n"), cy, params())
    assert rows(during, "uniqueid", "dtc_code", "episode_no", "engine_cycles_during") == [
        (*e[:3], sum(1 for u, c in cycles if u == e[0] and e[3] <= c <= e[4])) for e in want]
    # next cycle strictly after the end and before the next episode
    newest = max(ts for *_, ts in events)
    res = {r[:3]: r[3:] for r in rows(
        batch_episodes.resolution_by_next_cycle(ev, cy, gap, 600), "uniqueid", "dtc_code", "episode_no", "is_resolved",
        "resolution_reason")}
    for i, e in enumerate(want):
        nxt = want[i + 1][3] if i + 1 < len(want) and want[i + 1][:2] == e[:2] else None
        found = any(u == e[0] and c > e[4] and (nxt is None or c < nxt) for u, c in cycles)
        ambiguous = e[4] > max(0, newest - 600)
        want_res = (int(found and not ambiguous), "recent_window_ambiguous" if ambiguous
                    else "engine_cycle_no_reappearance" if found else "")
        assert res[e[:3]] == want_res


def test_numbering_example(spark):
    events = [("V1", "P0128", T0 + d) for d in (100, 105, 110, 2000, 2005)]
    cy = spark.createDataFrame([], CY)
    ev = spark.createDataFrame(events, EV)
    out = episodes.number_event_seconds(episodes.event_seconds(ev), cy, params(gap=1800))
    assert rows(out, "ts", "is_break", "episode_no") == [
        (T0 + 100, 1, 1), (T0 + 105, 0, 1), (T0 + 110, 0, 1), (T0 + 2000, 1, 2), (T0 + 2005, 0, 2)]
    assert rows(episodes.previous_event(ev), "ts", "prev_ts")[:2] == [(T0 + 100, 0), (T0 + 105, T0 + 100)]


def test_episode_over_midnight_is_one(spark):
    midnight = (T0 // 86400 + 1) * 86400
    got, *_ = engine(spark, [("V", "P", midnight - 5), ("V", "P", midnight + 5)], [], params())
    assert rows(got, *COLS) == [("V", "P", 1, midnight - 5, midnight + 5, 2, 0)]


def test_duplicate_second_opens_no_second_episode(spark):
    got, *_ = engine(spark, [("V", "P", T0), ("V", "P", T0 + 9), ("V", "P", T0 + 9)], [("V", T0 + 9)], params())
    assert rows(got, *COLS) == [("V", "P", 1, T0, T0, 1, 0), ("V", "P", 2, T0 + 9, T0 + 9, 2, 1)]


@pytest.mark.parametrize("age_h, cycle, want", [(72, True, 1), (1, True, 0), (37 * 24, False, 0), (1, False, 0)])
def test_resolution_scenarios(spark, age_h, cycle, want):
    p = params(cutoff=86400)
    last = p.as_of - age_h * 3600
    cycles = [("V", last + 600)] if cycle else [("V", last - 600)]
    got, _, cy = engine(spark, [("V", "P", last)], cycles, p)
    assert episodes.resolution(got, cy, p).first()["is_resolved"] == want


def test_risk_and_score_example(spark):
    eps = spark.createDataFrame(
        [("V", "A", 86400, 0, 1), ("V", "B", 43200, 0, 2), ("V", "C", 0, 1, 1)],
        "uniqueid string, dtc_code string, resolution_time_sec long, is_resolved int, ep_count long")
    codes = spark.createDataFrame([("A", 3), ("B", 2)], "dtc_code string, severity_level int")
    out = fault_master.vehicle_risk(eps, codes).select("risk", scoring.health_score("risk", 0.2).alias("s")).first()
    assert out["risk"] == pytest.approx(12.425) and out["s"] == pytest.approx(97.515)


def test_factors_and_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (2), (5) t(n)")
    assert [r[0] for r in df.select(scoring.recurrence_factor("n")).collect()] == [1.0, 1.5, 3.0]
    lv = spark.sql("SELECT * FROM VALUES (CAST(NULL AS INT)), (0), (1), (2), (3), (4) t(l)")
    assert [r[0] for r in lv.select(scoring.severity_multiplier("l")).collect()] == [1, 1, 1, 3, 7, 12]
    assert [r[0] for r in lv.select(scoring.code_severity_type("l")).collect()] == [
        "Unknown", "Info", "Minor", "Major", "Critical", "Critical"]
    floor = spark.sql("SELECT * FROM VALUES (1e9), (0.0), (CAST(NULL AS DOUBLE)) t(r)")
    assert [r[0] for r in floor.select(scoring.health_score("r", 0.2)).collect()] == [0.0, 100.0, 100.0]
    tr = spark.sql("SELECT * FROM VALUES (13, 10), (12, 10), (8, 10), (9, 10), (0, 0), (2, 0) t(r, p)")
    assert [r[0] for r in tr.select(scoring.fault_trend("r", "p")).collect()] == [
        "increasing", "stable", "decreasing", "stable", "stable", "increasing"]


def test_hot_vehicle_is_spread(spark):
    """A vehicle with a third of all messages: its rows meet in (vehicle, slice)
    groups of collapsed seconds, and only slice sessions meet per vehicle."""
    day = T0 - T0 % 86400
    hot = spark.range(60_000).selectExpr(
        "'HOT' AS uniqueid", "'P' AS dtc_code", f"{day} + (id * 7919) % (20 * 86400) div 600 * 600 AS ts")
    cold = spark.range(120_000).selectExpr("concat('V', id % 5000) AS uniqueid", "'P' AS dtc_code", f"{day} + id * 14 AS ts")
    ev = hot.unionByName(cold)
    cy = spark.createDataFrame([("HOT", day + 86400 * d + 100) for d in range(20)], CY)
    p = Params(as_of=day + 21 * 86400)
    seconds = episodes.event_seconds(ev)
    looked = episodes.with_last_cycle(seconds, cy, p)
    biggest = looked.filter("uniqueid = 'HOT'").groupBy("slice").count().agg({"count": "max"}).first()[0]
    assert biggest <= 86400 // 600
    parts = episodes.slice_sessions(looked, p.gap).filter("uniqueid = 'HOT'").count()
    assert parts <= 20 * 2
    out = episodes.episode_agg(seconds, cy, p)
    assert out.agg({"occurrence_count": "sum"}).first()[0] == 180_000
    assert out.filter("uniqueid = 'HOT'").count() == 21
