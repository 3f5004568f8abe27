"""Vehicle risk and the central fault table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import (
    clamp_severity, clean_text, duration_factor, episode_key, event_date, health_score, issue_flags,
    recurrence_factor, severity_multiplier,
)
from faultloom.operators.episodes import resolved_episodes
from faultloom.params import Params
from faultloom.session import stored

FAULT_COLUMNS = [
    "episode_id", "clientLoginId", "uniqueid", "vehicle_number", "customer_name", "model", "manufacturing_year",
    "dtc_code", "system", "subsystem", "description", "severity_level", "first_ts", "last_ts", "event_date",
    "occurrence_count", "resolution_time_sec", "is_resolved", "resolution_reason", "gap_from_previous_episode",
    "engine_cycles_during", "driver_related", "has_engine_issue", "has_coolant_issue", "has_safety_issue",
    "has_emission_issue", "has_electrical_issue", "vehicle_health_score",
]

CODE_COLUMNS = ["dtc_code", "system", "subsystem", "description", "severity_level", "driver_related"]


def episode_risk(severity: str = "dm_severity"):
    return severity_multiplier(severity) * duration_factor("resolution_time_sec") * recurrence_factor("ep_count")


def occurring(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """The codes that ``rows`` name.

    Most rows name a few codes of a long list. The exchange of its own lets
    adaptive execution measure what is left of the list, and broadcast it if it
    is small instead of dealing all rows by code.
    """
    named = rows.select("dtc_code").distinct()
    return codes.join(named, "dtc_code", "left_semi").repartition("dtc_code")


def _risk(episodes: DataFrame, named: DataFrame) -> DataFrame:
    rated = episodes.filter("is_resolved = 0").join(
        named.select("dtc_code", F.col("severity_level").alias("dm_severity")), "dtc_code", "left")
    return rated.groupBy("uniqueid").agg(F.sum(episode_risk()).alias("risk"))


def vehicle_risk(episodes: DataFrame, codes: DataFrame) -> DataFrame:
    """Risk of every vehicle with an open episode."""
    return _risk(episodes, occurring(codes.select("dtc_code", "severity_level"), episodes))


def fault_master_from_episodes(
    episodes: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params,
) -> DataFrame:
    """One row per episode with vehicle, code attributes, flags and score."""
    return _fault_rows(episodes, vehicles, occurring(codes.select(*CODE_COLUMNS), episodes), params)


def fault_master_from_stored(
    episodes: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params,
) -> DataFrame:
    """The same for episodes that are stored.

    The codes they name are stored first: their size is known before the plan
    is made, so episodes are not dealt by code where the few codes they show fit
    a broadcast, and risk and fault rows search the list once.
    """
    return _fault_rows(episodes, vehicles, stored(occurring(codes.select(*CODE_COLUMNS), episodes)), params)


def _fault_rows(episodes: DataFrame, vehicles: DataFrame, named: DataFrame, params: Params) -> DataFrame:
    """The risk is aggregated per vehicle and attached to the vehicle master, so
    that the episodes pass a single join on the vehicle."""
    dm = named.select(
        "dtc_code", F.col("system").alias("dm_system"), F.col("subsystem").alias("dm_subsystem"),
        F.col("description").alias("dm_description"), F.col("severity_level").alias("dm_severity"),
        F.col("driver_related").alias("dm_driver"))
    vm = vehicles.select(
        "clientLoginId", "uniqueid", "vehicle_number", "customer_name", "model", "manufacturing_year")
    rated = episodes.join(dm, "dtc_code", "left")
    vm = vm.join(_risk(episodes, named), "uniqueid", "left")
    flags = [c.alias(n) for n, c in issue_flags("dm_system", "dm_subsystem").items()]
    return rated.join(vm, "uniqueid").select(
        "*", *flags,
        episode_key().alias("episode_id"),
        clean_text("dm_system").alias("system"), clean_text("dm_subsystem").alias("subsystem"),
        clean_text("dm_description", none_word=False).alias("description"),
        clamp_severity("dm_severity").alias("severity_level"),
        event_date("first_ts").alias("event_date"), F.lit("").alias("resolution_reason"),
        F.coalesce("dm_driver", F.lit(0)).cast("int").alias("driver_related"),
        health_score("risk", params.k).alias("vehicle_health_score"),
    ).select(*FAULT_COLUMNS)


def vehicle_fault_master(
    events: DataFrame, cycles: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params,
) -> DataFrame:
    """The fault table of some events. The episodes are stored first, as risk and fault rows both read them."""
    episodes = stored(resolved_episodes(events, cycles, params))
    return fault_master_from_stored(episodes, vehicles, codes, params)
