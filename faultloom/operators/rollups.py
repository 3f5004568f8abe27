"""The eight analytics tables.

All but the maintenance list and the daily trend start from one aggregate per
tenant, vehicle and code (``vehicle_code_stats``). On it the distinct counts of
vehicles become plain counts, and the recurrence factor, constant per vehicle
and code, is applied once per row instead of being joined back to every episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import (
    count_where, duration_factor, fault_trend, has_lasted, health_score, heaviest, is_open, is_severe,
    mean_positive, recurrence_factor, severity_multiplier,
)
from faultloom.operators.fault_master import occurring
from faultloom.params import Params
from faultloom.sources.readers import latest_by_key


def vehicle_code_stats(vfm: DataFrame, params: Params) -> DataFrame:
    week, fortnight = F.lit(params.days_ago(7)), F.lit(params.days_ago(14))
    flags = ["has_engine_issue", "has_emission_issue", "has_safety_issue", "has_electrical_issue"]
    base = vfm.groupBy("clientLoginId", "uniqueid", "dtc_code").agg(
        F.min("description").alias("description"), F.min("system").alias("system"),
        F.min("subsystem").alias("subsystem"), F.min("severity_level").alias("severity_level"),
        F.count("*").alias("episodes"), count_where(is_open()).alias("active"),
        count_where(is_open() & is_severe()).alias("critical"), F.sum("occurrence_count").alias("occurrences"),
        F.sum(F.when(has_lasted(), F.col("resolution_time_sec"))).alias("lasted_sec"), count_where(has_lasted()).alias("lasted"),
        count_where(F.col("driver_related") == 1).alias("driver_faults"),
        F.sum(F.when(is_open(), severity_multiplier("severity_level")).otherwise(0.0)).alias("severity_sum"),
        F.sum(F.when(is_open(), severity_multiplier("severity_level") * duration_factor("resolution_time_sec"))
              .otherwise(0.0)).alias("weighted_sum"),
        count_where(F.col("first_ts") >= params.thirty_days_ago_ts).alias("last_30"),
        F.max("last_ts").alias("last_ts"),
        count_where(is_open() & (F.col("event_date") >= week)).alias("recent_active"),
        count_where(is_open() & (F.col("event_date") >= fortnight) & (F.col("event_date") < week)).alias("prior_active"),
        *[F.max(f).alias(f) for f in flags],
    )
    return base.withColumn("risk", F.col("weighted_sum") * recurrence_factor("episodes")).drop("weighted_sum")


def weighted_mode(df: DataFrame, group: list[str], key: str, weight: str, out: str) -> DataFrame:
    """Key with the largest summed weight per group, ties to the smallest key."""
    sums = df.groupBy(*group, key).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*group).agg(heaviest(key, "_w").alias(out))


def fleet_health_summary(stats: DataFrame, vehicles: DataFrame, params: Params) -> DataFrame:
    per_vehicle = stats.groupBy("clientLoginId", "uniqueid").agg(
        F.sum("active").alias("active"), F.sum("critical").alias("critical"),
        F.sum("driver_faults").alias("driver_faults"), F.sum("risk").alias("risk"),
        F.sum("recent_active").alias("recent_active"), F.sum("prior_active").alias("prior_active"))
    fleet = per_vehicle.groupBy("clientLoginId").agg(
        count_where(F.col("active") > 0).alias("active_veh"), count_where(F.col("critical") > 0).alias("critical_veh"),
        F.sum("driver_faults").alias("driver_faults"), F.sum("risk").alias("risk_sum"),
        F.sum("recent_active").alias("recent_active"), F.sum("prior_active").alias("prior_active"))
    totals = vehicles.groupBy("clientLoginId").agg(F.count("*").alias("total_vehicles"))
    tenant = ["clientLoginId"]
    joined = (
        totals.join(fleet, tenant, "left")
        .join(weighted_mode(stats, tenant, "dtc_code", "occurrences", "top_code"), tenant, "left")
        .join(weighted_mode(stats, tenant, "system", "occurrences", "top_system"), tenant, "left")
    )
    zero = F.lit(0)
    mean_risk = F.col("risk_sum") / F.greatest(F.col("active_veh").cast("double"), F.lit(1.0))
    return joined.select(
        "clientLoginId", "total_vehicles",
        F.coalesce("active_veh", zero).alias("vehicles_with_active_faults"),
        F.coalesce("critical_veh", zero).alias("vehicles_with_critical_faults"),
        F.coalesce("driver_faults", zero).alias("driver_related_faults"),
        F.when(F.coalesce("active_veh", zero) > 0, health_score(mean_risk, params.k))
        .otherwise(100.0).alias("fleet_health_score"),
        F.coalesce("top_code", F.lit("")).alias("most_common_dtc"),
        F.coalesce("top_system", F.lit("")).alias("most_common_system"),
        fault_trend("recent_active", "prior_active").alias("active_fault_trend"),
    )


def fleet_dtc_distribution(stats: DataFrame) -> DataFrame:
    return stats.groupBy("clientLoginId", "dtc_code").agg(
        F.min("description").alias("description"), F.min("system").alias("system"),
        F.min("subsystem").alias("subsystem"), F.min("severity_level").alias("severity_level"),
        F.count("*").alias("vehicles_affected"), count_where(F.col("active") > 0).alias("active_vehicles"),
        F.sum("occurrences").alias("total_occurrences"), F.sum("episodes").alias("total_episodes"),
        mean_positive(F.sum("lasted_sec"), F.sum("lasted")).alias("avg_resolution_time"),
        F.sum("driver_faults").alias("driver_related_count"),
    )


def fleet_system_health(stats: DataFrame) -> DataFrame:
    named = stats.withColumn("system", F.when(F.col("system").isin("", "nan"), "other").otherwise(F.col("system")))
    per_vehicle = named.groupBy("clientLoginId", "system", "uniqueid").agg(
        F.sum("active").alias("active"), F.sum("critical").alias("critical"), F.sum("severity_sum").alias("sev"))
    return per_vehicle.groupBy("clientLoginId", "system").agg(
        count_where(F.col("active") > 0).alias("vehicles_affected"), F.sum("active").alias("active_faults"),
        F.sum("critical").alias("critical_faults"), F.sum("sev").alias("risk_score"),
    ).withColumn("trend", F.lit("stable"))


def fleet_fault_trends(vfm: DataFrame, params: Params) -> DataFrame:
    per_vehicle = vfm.groupBy("clientLoginId", "event_date", "uniqueid").agg(
        count_where(is_open()).alias("active"), count_where(is_open() & is_severe()).alias("critical"), F.count("*").alias("n"),
        count_where(F.col("is_resolved") == 1).alias("resolved"),
        count_where(F.col("driver_related") == 1).alias("driver"),
        F.sum(F.when(is_open(), severity_multiplier("severity_level")).otherwise(0.0)).alias("sev"))
    mean_severity = F.sum("sev") / F.greatest(count_where(F.col("active") > 0), F.lit(1))
    return per_vehicle.groupBy("clientLoginId", F.col("event_date").alias("date")).agg(
        F.sum("active").alias("active_faults"), F.sum("critical").alias("critical_faults"),
        F.sum("n").alias("new_faults"), F.sum("resolved").alias("resolved_faults"),
        F.sum("driver").alias("driver_related_faults"),
        health_score(mean_severity, params.k).alias("fleet_health_score"),
    )


def vehicle_health_summary(stats: DataFrame, vehicles: DataFrame, params: Params) -> DataFrame:
    """One row per vehicle of the master; fault-free vehicles score 100."""
    per_vehicle = stats.groupBy("clientLoginId", "uniqueid").agg(
        F.sum("active").alias("active"), F.sum("critical").alias("critical"), F.sum("episodes").alias("episodes"),
        F.sum("last_30").alias("last_30"), mean_positive(F.sum("lasted_sec"), F.sum("lasted")).alias("mean_sec"),
        F.max("last_ts").alias("last_ts"), F.sum("risk").alias("risk"),
        F.sum("driver_faults").alias("driver_faults"), heaviest("dtc_code", "occurrences").alias("top_code"),
        *[F.max(f"has_{n}_issue").alias(f"{n}_flag") for n in ("engine", "emission", "safety", "electrical")])
    zero = F.lit(0)
    return vehicles.join(per_vehicle, ["clientLoginId", "uniqueid"], "left").select(
        "clientLoginId", "uniqueid", "vehicle_number", "customer_name",
        F.coalesce("active", zero).alias("active_fault_count"),
        F.coalesce("critical", zero).alias("critical_fault_count"),
        F.coalesce("episodes", zero).alias("total_episodes"),
        F.coalesce("last_30", zero).alias("episodes_last_30_days"),
        F.coalesce("mean_sec", F.lit(0.0)).alias("avg_resolution_time"),
        F.coalesce("last_ts", zero).alias("last_fault_ts"),
        health_score("risk", params.k).alias("vehicle_health_score"),
        F.coalesce("driver_faults", zero).alias("driver_related_faults"),
        F.coalesce("top_code", F.lit("")).alias("most_common_dtc"),
        *[F.coalesce(f"{n}_flag", zero).alias(f"has_{n}_issue")
          for n in ("engine", "emission", "safety", "electrical")],
    )


def dtc_fleet_impact(stats: DataFrame) -> DataFrame:
    return stats.groupBy("clientLoginId", "dtc_code").agg(
        F.min("system").alias("system"), F.min("subsystem").alias("subsystem"),
        F.count("*").alias("vehicles_affected"), count_where(F.col("active") > 0).alias("active_vehicles"),
        mean_positive(F.sum("lasted_sec"), F.sum("lasted")).alias("avg_resolution_time"),
        mean_positive(F.sum("driver_faults"), F.sum("episodes")).alias("driver_related_ratio"),
        F.sum("severity_sum").alias("fleet_risk_score"),
    )


def maintenance_candidates(vfm: DataFrame, stats: DataFrame, codes: DataFrame) -> DataFrame:
    """One scored row per open episode."""
    recent = stats.groupBy("uniqueid", "dtc_code").agg(F.sum("last_30").alias("eps_30"))
    actions = codes.select("dtc_code", F.col("action_required").alias("recommended_action"))
    eps = F.coalesce("eps_30", F.lit(0))
    score = severity_multiplier("severity_level") * duration_factor("resolution_time_sec") * (1.0 + eps)
    open_ = vfm.filter(is_open())
    return open_.join(recent, ["uniqueid", "dtc_code"], "left").join(occurring(actions, open_), "dtc_code", "left").select(
        "clientLoginId", "uniqueid", "vehicle_number", "dtc_code", "description", "severity_level",
        F.col("resolution_time_sec").alias("fault_duration_sec"), eps.alias("episodes_last_30_days"),
        score.alias("maintenance_priority_score"),
        F.coalesce("recommended_action", F.lit("")).alias("recommended_action"),
    )


def maintenance_priority(vfm: DataFrame, stats: DataFrame, codes: DataFrame) -> DataFrame:
    """The stored list: the highest-scored open episode per vehicle and code."""
    return latest_by_key(
        maintenance_candidates(vfm, stats, codes), ["clientLoginId", "uniqueid", "dtc_code"],
        ["maintenance_priority_score", "fault_duration_sec"])


def dtc_cooccurrence(stats: DataFrame) -> DataFrame:
    """Ordered code pairs on at least two vehicles.

    A pair's vehicles, episode sum, last second and tenant depend only on the
    *set* of codes a vehicle shows. Vehicles are therefore grouped by that set
    first, and pairs are formed once per distinct set: fleets of like vehicles
    share few sets, however many vehicles or episodes stand behind one.

    Every vehicle counts, however many codes it shows. The partners of each
    anchor code of a set are formed in separate tasks, so a set of any size is
    spread; the pairs are bounded by the square of the code vocabulary.
    """
    per_vehicle = stats.groupBy("uniqueid").agg(
        F.min("clientLoginId").alias("clientLoginId"), F.count_distinct("dtc_code").alias("codes"),
        F.sum("episodes").alias("episodes"), F.max("last_ts").alias("last_ts")).filter("codes >= 2")
    members = stats.select("uniqueid", "dtc_code").join(per_vehicle.select("uniqueid"), "uniqueid", "left_semi")
    sets = members.groupBy("uniqueid").agg(F.sort_array(F.collect_set("dtc_code")).alias("codes"))
    by_set = sets.join(per_vehicle.drop("codes"), "uniqueid").groupBy("codes").agg(
        F.min("clientLoginId").alias("clientLoginId"), F.count("*").alias("vehicles"),
        F.sum("episodes").alias("episodes"), F.max("last_ts").alias("last_ts"))
    anchored = by_set.select("*", F.posexplode("codes").alias("i", "dtc_code_a")).repartition("dtc_code_a", "i")
    pairs = anchored.select(
        "clientLoginId", "vehicles", "episodes", "last_ts", "dtc_code_a",
        F.explode(F.slice("codes", F.col("i") + 2, F.size("codes"))).alias("dtc_code_b"))
    return pairs.groupBy("dtc_code_a", "dtc_code_b").agg(
        F.min("clientLoginId").alias("clientLoginId"), F.sum("episodes").alias("cooccurrence_count"),
        F.sum("vehicles").alias("vehicles_affected"), F.lit(0.0).alias("avg_time_gap_sec"),
        F.max("last_ts").alias("last_seen_ts"),
    ).filter("vehicles_affected >= 2").select(
        "clientLoginId", "dtc_code_a", "dtc_code_b", "cooccurrence_count", "vehicles_affected",
        "avg_time_gap_sec", "last_seen_ts")
