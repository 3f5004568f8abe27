"""Plan shape: what reaches the scan, what is shuffled, and what is not there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faultloom.operators import conversations, dashboard
from testbed import traces as tb
from testbed.inputs import PARAMS, warehouse
from tests.conftest import SF


def plan(df, mode="simple"):
    jvm = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(jvm.fromString(mode))


@pytest.fixture(scope="module")
def w(spark):
    return warehouse(spark, SF)


def test_episodes_shuffle_events_twice_and_sessions_once(w):
    text = plan(w.build("fault_episodes"))
    # seconds, slices, sessions; then cycle seconds (twice, reused at run time), their slices, carry rows, last cycle
    exchanges = [line.split("hashpartitioning")[1].split(",")[0:3] for line in text.splitlines() if "Exchange hash" in line]
    assert len(exchanges) == 8, exchanges
    assert "windowspecdefinition(uniqueid#" in text and "unboundedpreceding$(), unboundedfollowing$())) AS risk" not in text
    # raw messages are read once, for the stored events; episodes read of these what they need
    scans = [b for b in plan(w.build("fault_episodes"), "formatted").split("\n\n") if "ReadSchema" in b]
    assert not any("Not(EqualTo(event_type,signup))" in b for b in scans)
    assert any("ReadSchema: struct<uniqueid:string,ts:bigint,dtc_code:string>" in b for b in scans)
    raw = [b for b in plan(w.build("dtc_events_exploded"), "formatted").split("\n\n") if "PushedFilters" in b]
    messages = next(b for b in raw if "Not(EqualTo(event_type,signup))" in b)
    assert "GreaterThanOrEqual(ts" in messages and "LessThan(ts" in messages
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text


def test_dashboard_reads_only_what_it_needs(w):
    text = plan(dashboard.dtc_trend(w, "P0001", 14), "formatted")
    scan = next(block for block in text.split("\n\n") if "PushedFilters" in block)
    assert "ReadSchema: struct<dtc_code:string,event_date:date,occurrence_count:bigint>" in scan
    assert "EqualTo(dtc_code,P0001)" in scan and "GreaterThanOrEqual(event_date" in scan


def test_rankings_take_ordered(w):
    assert "TakeOrderedAndProject" in plan(dashboard.dtc_summary(w, 14))


def test_last_messages_are_limited_before_the_shuffle(spark):
    text = plan(conversations.recent_messages(tb.messages(spark, SF), 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_invariants(w):
    events, vfm = w.build("dtc_events_exploded"), w.vfm
    assert events.count() == vfm.agg(F.sum("occurrence_count")).first()[0]
    assert vfm.filter("vehicle_health_score < 0 OR vehicle_health_score > 100 OR last_ts < first_ts").count() == 0
    overlap = vfm.alias("a").join(vfm.alias("b"), F.expr(
        "a.uniqueid = b.uniqueid AND a.dtc_code = b.dtc_code AND a.first_ts < b.first_ts AND a.last_ts >= b.first_ts"))
    assert overlap.count() == 0
    assert w.distribution.agg(F.sum("total_episodes")).first()[0] == vfm.count()
    assert w.trends.agg(F.sum("new_faults")).first()[0] == vfm.count()
    assert w.vhs.agg(F.sum("total_episodes")).first()[0] == vfm.count()
    assert w.params == PARAMS
