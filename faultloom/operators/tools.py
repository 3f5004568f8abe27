"""Assistant tool queries. ``customer`` switches to the customer-scoped form,
which is computed from the fault table; without it the stored tables answer for
the whole fleet, one row per code, date or system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import (
    by_driver, count_where, has_lasted, is_open, is_severe, mean_positive, settle, severity_multiplier,
)
from faultloom.operators import rollups
from faultloom.operators.dashboard import _other_codes, fleet_health_snap, of_customer, recent
from faultloom.params import MAX_RESULT_ROWS, checked_limit


def capped(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows handed to the assistant: as many as asked for, else the default number."""
    return df.limit(checked_limit(limit, MAX_RESULT_ROWS, 1))


def _as_one_fleet(stats: DataFrame) -> DataFrame:
    """All tenants as one; a vehicle belongs to one of them, so its rows stay apart."""
    return stats.withColumn("clientLoginId", F.lit(""))


def fleet_health_totals(w, customer: str | None = None) -> DataFrame:
    zero = F.lit(0)
    return of_customer(w.vhs, customer).agg(
        F.count("*").alias("total_vehicles"), count_where(F.col("active_fault_count") > 0).alias("vehicles_with_active_faults"),
        count_where(F.col("critical_fault_count") > 0).alias("vehicles_with_critical_faults"),
        settle(F.avg("vehicle_health_score"), 1).alias("avg_health_score"),
        F.coalesce(F.sum("active_fault_count"), zero).alias("total_active_faults"),
        F.coalesce(F.sum("critical_fault_count"), zero).alias("total_critical_faults"),
        F.coalesce(F.sum("driver_related_faults"), zero).alias("total_driver_related_faults"))


def fleet_health_snapshot(w, customer: str | None = None) -> DataFrame:
    """Without a customer: all tenants together. One scan of the fault table with one."""
    if not customer:
        return fleet_health_snap(w)
    faults = of_customer(w.vfm, customer)
    # a row per vehicle, code and system; the occurrences of a code or system meet in the second step
    per_code = faults.groupBy("uniqueid", "dtc_code", "system").agg(
        F.max(F.when(is_open(), 1)).alias("open"), F.max(F.when(is_open() & is_severe(), 1)).alias("severe"),
        count_where(by_driver()).alias("driver"), F.sum("occurrence_count").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (
        ("vehicle", F.col("uniqueid")), ("code", F.col("dtc_code")), ("system", F.col("system")))])
    per_value = per_code.select("open", "severe", "driver", "n", F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(
        F.max("open").alias("open"), F.max("severe").alias("severe"), F.sum("driver").alias("driver"), F.sum("n").alias("n"))
    vehicle = F.col("kind") == "vehicle"
    top = lambda kind: F.coalesce(F.min_by("value", F.when(
        (F.col("kind") == kind) & F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))), F.lit(""))
    return per_value.agg(
        count_where(vehicle).alias("total_vehicles"), count_where(vehicle & F.col("open").isNotNull()).alias("vehicles_with_active_faults"),
        count_where(vehicle & F.col("severe").isNotNull()).alias("vehicles_with_critical_faults"),
        F.coalesce(F.sum(F.when(vehicle, F.col("driver"))), F.lit(0)).alias("driver_related_faults"),
        top("code").alias("most_common_dtc"), top("system").alias("most_common_system"))


def fleet_health_recent_trend(w, customer: str | None = None, days: int = 30, dates: int = 7) -> DataFrame:
    """The newest ``dates`` days; without a customer of all tenants together."""
    days = checked_limit(days, 30, 1)
    if customer:
        return of_customer(recent(w, days), customer).groupBy(F.col("event_date").alias("date")).agg(
            F.count("*").alias("active_faults"), count_where(F.col("is_resolved") == 1).alias("resolved_faults"),
            count_where(by_driver()).alias("driver_related_faults")).orderBy(F.desc("date")).limit(int(dates))
    return w.trends.groupBy("date").agg(
        settle(F.avg("fleet_health_score"), 2).alias("fleet_health_score"), F.sum("active_faults").alias("active_faults"),
        F.sum("resolved_faults").alias("resolved_faults"), F.sum("driver_related_faults").alias("driver_related_faults"),
    ).orderBy(F.desc("date")).limit(int(dates))


def fleet_dtc_distribution(w, customer: str | None = None, days: int = 30, limit: int = 10) -> DataFrame:
    limit, days = checked_limit(limit, 10, 1), checked_limit(days, 30, 1)
    cols = ["dtc_code", "description", "system", "subsystem", "severity_level", "vehicles_affected", "active_vehicles",
            "total_occurrences", "total_episodes", settle("avg_resolution_time", 1).alias("avg_resolution_time"),
            "driver_related_count"]
    if not customer:
        fleet = rollups.fleet_dtc_distribution(_as_one_fleet(w.stats))
        return fleet.orderBy(F.desc("total_occurrences"), "dtc_code").limit(limit).select(*cols)
    per_vehicle = of_customer(recent(w, days), customer).groupBy("dtc_code", "uniqueid").agg(
        F.min("description").alias("description"), F.min("system").alias("system"),
        F.min("subsystem").alias("subsystem"), F.min("severity_level").alias("severity_level"),
        F.max(F.when(is_open(), 1)).alias("open"), F.sum("occurrence_count").alias("occ"), F.count("*").alias("n"),
        F.sum(F.when(has_lasted(), F.col("resolution_time_sec"))).alias("sec"), count_where(has_lasted()).alias("lasted"),
        count_where(by_driver()).alias("driver"))
    return per_vehicle.groupBy("dtc_code").agg(
        F.min("description").alias("description"), F.min("system").alias("system"),
        F.min("subsystem").alias("subsystem"), F.min("severity_level").alias("severity_level"),
        F.count("*").alias("vehicles_affected"), F.count("open").alias("active_vehicles"),
        F.sum("occ").alias("total_occurrences"), F.sum("n").alias("total_episodes"),
        mean_positive(F.sum("sec"), F.sum("lasted")).alias("avg_resolution_time"),
        F.sum("driver").alias("driver_related_count"),
    ).orderBy(F.desc("total_occurrences"), "dtc_code").limit(limit).select(*cols)


def fleet_trends(w, customer: str | None = None, days: int = 30) -> DataFrame:
    days = checked_limit(days, 30, 1)
    if customer:
        return of_customer(recent(w, days), customer).groupBy(F.col("event_date").alias("date")).agg(
            F.count("*").alias("active_faults"), F.count("*").alias("new_faults"),
            count_where(F.col("is_resolved") == 1).alias("resolved_faults"),
            count_where(by_driver()).alias("driver_related_faults")).orderBy("date")
    # a tenant's score counts as often as it has episodes that day
    score = F.sum(F.col("fleet_health_score") * F.col("new_faults")) / F.sum("new_faults")
    return w.trends.groupBy("date").agg(
        settle(score, 2).alias("fleet_health_score"),
        *[F.sum(c).alias(c) for c in ("active_faults", "new_faults", "resolved_faults", "driver_related_faults")]).orderBy("date")


def _of_vehicle(df: DataFrame, vehicle_number: str | None, uniqueid: str | None) -> DataFrame:
    number, uid = (vehicle_number or "").strip(), (uniqueid or "").strip()
    if number:
        return df.filter(F.col("vehicle_number") == number)
    if uid:
        return df.filter(F.col("uniqueid") == uid)
    raise ValueError("give a vehicle number or a uniqueid")


def vehicle_health_status(w, vehicle_number: str | None = None, uniqueid: str | None = None) -> DataFrame:
    return _of_vehicle(w.vhs, vehicle_number, uniqueid).orderBy("uniqueid").limit(1).select(
        "uniqueid", "vehicle_number", "customer_name", "vehicle_health_score", "active_fault_count",
        "critical_fault_count", "total_episodes", "episodes_last_30_days",
        settle("avg_resolution_time", 1).alias("avg_resolution_time"), "driver_related_faults", "most_common_dtc",
        "has_engine_issue", "has_emission_issue", "has_safety_issue", "has_electrical_issue")


def vehicle_fault_summary(w, vehicle_number: str | None = None, uniqueid: str | None = None, limit: int = 15) -> DataFrame:
    return _of_vehicle(w.vfm, vehicle_number, uniqueid).groupBy("dtc_code", "system", "description").agg(
        F.count("*").alias("episodes"), F.max("severity_level").alias("max_severity"),
        count_where(is_open()).alias("unresolved"), F.min("first_ts").alias("earliest_ts"),
        F.max("last_ts").alias("latest_ts"), settle(F.avg("resolution_time_sec"), 0).alias("avg_resolution_sec"),
    ).orderBy(F.desc("unresolved"), F.desc("episodes"), "dtc_code").limit(int(limit))


def vehicle_faults(
    w, vehicle_number: str | None = None, uniqueid: str | None = None, unresolved_only: bool = False, days: int = 90,
    limit: int = 50,
) -> DataFrame:
    days = checked_limit(days, 90, 1)
    rows = recent(w, days, _of_vehicle(w.vfm, vehicle_number, uniqueid))
    if unresolved_only:
        rows = rows.filter(is_open())
    return rows.orderBy(F.desc("event_date"), F.desc("severity_level"), "episode_id").limit(int(limit)).select(
        "episode_id", "dtc_code", "system", "subsystem", "description", "severity_level", "is_resolved", "event_date",
        "first_ts", "last_ts", "occurrence_count", "resolution_time_sec", "driver_related", "vehicle_health_score")


def dtc_details(w, codes: list[str]) -> DataFrame:
    wanted = [str(c).strip() for c in codes if str(c).strip()]
    if not wanted:
        raise ValueError("give at least one code")
    return w.dm.filter(F.col("dtc_code").isin(*wanted)).select(
        "dtc_code", "system", "subsystem", "description", "primary_cause", "secondary_causes", "symptoms",
        "impact_if_unresolved", "severity_level", "safety_risk_level", "action_required", "repair_complexity",
        "fleet_management_action", "recommended_preventive_action", "driver_related", "driver_behaviour_category",
        "driver_behaviour_trigger", "driver_training_required")


def dtc_cooccurrence(w, dtc_code: str, customer: str | None = None, limit: int = 15) -> DataFrame:
    if customer:
        rows = _other_codes(of_customer(w.vfm, customer), dtc_code, "cooccurring_dtc")
    else:
        a, b = F.col("dtc_code_a"), F.col("dtc_code_b")
        rows = w.cooccurrence.filter((a == dtc_code) | (b == dtc_code)).select(
            F.when(a == dtc_code, b).otherwise(a).alias("cooccurring_dtc"), "cooccurrence_count", "vehicles_affected",
            settle("avg_time_gap_sec", 0).alias("avg_time_gap_sec"))
    return rows.orderBy(F.desc("vehicles_affected"), "cooccurring_dtc").limit(int(limit))


def maintenance_priority(w, customer: str | None = None, limit: int = 10) -> DataFrame:
    """Without a customer the ranking is cut before the vehicle columns are joined."""
    limit = checked_limit(limit, 10, 1)
    order = [F.desc("maintenance_priority_score"), "uniqueid", "dtc_code"]
    v = w.vhs.select("uniqueid", "customer_name", "vehicle_health_score", "active_fault_count", "critical_fault_count")
    if customer:
        joined = w.maintenance.join(of_customer(v, customer), "uniqueid").orderBy(*order).limit(limit)
    else:
        joined = w.maintenance.orderBy(*order).limit(limit).join(v, "uniqueid", "left").orderBy(*order)
    return joined.select(
        "vehicle_number", "uniqueid", "customer_name", "dtc_code", "description", "severity_level",
        "maintenance_priority_score", "fault_duration_sec", "episodes_last_30_days", "recommended_action",
        "vehicle_health_score", "active_fault_count", "critical_fault_count")


def _open_severity() -> F.Column:
    return F.sum(F.when(is_open(), severity_multiplier("severity_level")).otherwise(0.0))


def fleet_system_health(w, customer: str | None = None) -> DataFrame:
    if customer:
        per_vehicle = of_customer(w.vfm, customer).filter("system <> ''").groupBy("system", "uniqueid").agg(
            F.max(F.when(is_open(), 1)).alias("open"), count_where(is_open()).alias("active"),
            count_where(is_open() & is_severe()).alias("critical"), _open_severity().alias("sev"))
        return per_vehicle.groupBy("system").agg(
            F.count("open").alias("vehicles_affected"), F.sum("active").alias("active_faults"),
            F.sum("critical").alias("critical_faults"), settle(F.sum("sev"), 1).alias("risk_score"),
        ).orderBy(F.desc("risk_score"), "system")
    # a vehicle counts with one tenant, and risk is a sum over open episodes: all four add up
    return w.systems.groupBy("system").agg(
        F.sum("vehicles_affected").alias("vehicles_affected"), F.sum("active_faults").alias("active_faults"),
        F.sum("critical_faults").alias("critical_faults"), settle(F.sum("risk_score"), 1).alias("risk_score"),
        F.min("trend").alias("trend")).orderBy(F.desc("risk_score"), "system")


def dtc_fleet_impact(w, customer: str | None = None, limit: int = 15) -> DataFrame:
    limit = checked_limit(limit, 15, 1)
    if not customer:
        rows = rollups.dtc_fleet_impact(_as_one_fleet(w.stats))
    else:
        per_vehicle = of_customer(w.vfm, customer).groupBy("dtc_code", "uniqueid").agg(
            F.min("system").alias("system"), F.min("subsystem").alias("subsystem"), F.max(F.when(is_open(), 1)).alias("open"),
            F.sum(F.when(has_lasted(), F.col("resolution_time_sec"))).alias("sec"), count_where(has_lasted()).alias("lasted"),
            count_where(by_driver()).alias("driver"), F.count("*").alias("n"), _open_severity().alias("sev"))
        rows = per_vehicle.groupBy("dtc_code").agg(
            F.min("system").alias("system"), F.min("subsystem").alias("subsystem"),
            F.count("*").alias("vehicles_affected"), F.count("open").alias("active_vehicles"),
            mean_positive(F.sum("sec"), F.sum("lasted")).alias("avg_resolution_time"),
            mean_positive(F.sum("driver"), F.sum("n")).alias("driver_related_ratio"),
            F.sum("sev").alias("fleet_risk_score"))
    return rows.orderBy(F.desc("fleet_risk_score"), "dtc_code").limit(limit).select(
        "dtc_code", "system", "subsystem", "vehicles_affected", "active_vehicles",
        settle("avg_resolution_time", 0).alias("avg_resolution_time"),
        settle("driver_related_ratio", 3).alias("driver_related_ratio"),
        settle("fleet_risk_score", 1).alias("fleet_risk_score"))
