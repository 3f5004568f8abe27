"""Dashboard queries over the analytics tables.

Each takes the warehouse ``w`` and parameters and returns a DataFrame.
``customer=None`` means all customers. Ranked results end with a key as the
last sort column, so a limit always keeps the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.functions.scoring import count_where, is_open, is_severe, settle

DEFAULT_ACTION = "Schedule preventive maintenance."  # fixed value


def of_customer(df: DataFrame, customer: str | None) -> DataFrame:
    return df.filter(F.col("customer_name") == customer) if customer else df


def of_customer_tenants(w, df: DataFrame, customer: str | None) -> DataFrame:
    """Rows of the tenants that have a vehicle of the customer."""
    if not customer:
        return df
    tenants = w.vm.filter(F.col("customer_name") == customer).select("clientLoginId").distinct()
    return df.join(tenants, "clientLoginId", "left_semi")


def of_customer_vehicles(w, df: DataFrame, customer: str | None) -> DataFrame:
    if not customer:
        return df
    return df.join(of_customer(w.vhs, customer).select("uniqueid"), "uniqueid", "left_semi")


def recent(w, days: int, df: DataFrame | None = None, col: str = "event_date") -> DataFrame:
    """Rows of the last ``days`` days. The stored tables are partitioned by
    month, which the date alone would not prune, so the month is given too."""
    df, start = (w.vfm if df is None else df), w.params.days_ago(days)
    if "event_month" in df.columns:
        df = df.filter(F.col("event_month") >= start.year * 100 + start.month)
    return df.filter(F.col(col) >= F.lit(start))


def _mean(col: Column) -> Column:
    return F.coalesce(F.avg(col), F.lit(0.0))


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _age_days(w) -> Column:
    return F.datediff(F.lit(w.params.today), F.col("event_date"))


def customer_names(w) -> DataFrame:
    return w.vhs.filter("customer_name <> ''").select("customer_name").distinct().orderBy("customer_name")


def customer_vehicles(w, customer: str) -> DataFrame:
    return of_customer(w.vhs, customer).select(
        "uniqueid", F.coalesce(F.nullif("vehicle_number", F.lit("")), F.col("uniqueid")).alias("vehicle_number"),
    ).orderBy("vehicle_number", "uniqueid")


def fleet_kpis(w, days: int = 30, customer: str | None = None) -> DataFrame:
    """Eight figures from one pass over each of the two tables."""
    vehicles = of_customer(w.vhs, customer).agg(
        F.count("*").alias("total_vehicles"), count_where(F.col("active_fault_count") > 0).alias("vehicles_with_dtcs"),
        count_where(F.col("critical_fault_count") > 0).alias("critical_vehicles"),
        settle(_mean(F.col("vehicle_health_score")), 2).alias("fleet_health_score"))
    is_recent = F.col("event_date") >= F.lit(w.params.days_ago(days))
    lasted = (F.col("is_resolved") == 1) & is_recent & (F.col("resolution_time_sec") > 0)
    # per vehicle first, so that the distinct count needs no second copy of the rows
    per_vehicle = of_customer(w.vfm, customer).groupBy("uniqueid").agg(
        F.sum(F.when(lasted, F.col("resolution_time_sec") / 86400.0)).alias("days"), count_where(lasted).alias("lasted"),
        F.max(F.when(is_open() & is_severe(), 1)).alias("due"),
        F.sum(F.when(is_recent, F.col("occurrence_count"))).alias("alerts"),
        count_where(is_severe() & is_recent).alias("critical_alerts"))
    faults = per_vehicle.agg(
        settle(F.coalesce(F.try_divide(F.sum("days"), F.sum("lasted")), F.lit(0.0)), 1).alias("avg_resolution_days"),
        F.count("due").alias("maintenance_due"), _zero(F.sum("alerts")).alias("total_dtc_alerts"),
        _zero(F.sum("critical_alerts")).alias("critical_alerts"))
    # two one-row results folded into one row
    names = ["total_vehicles", "vehicles_with_dtcs", "critical_vehicles", "avg_resolution_days", "fleet_health_score",
             "maintenance_due", "total_dtc_alerts", "critical_alerts"]
    return vehicles.unionByName(faults, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


def fleet_overview(w, customer: str | None = None) -> DataFrame:
    return of_customer(w.vhs, customer).agg(
        F.count("*").alias("total_vehicles"), count_where(F.col("active_fault_count") > 0).alias("active_fault_vehicles"),
        count_where(F.col("critical_fault_count") > 0).alias("critical_fault_vehicles"),
        _mean(F.col("vehicle_health_score")).alias("fleet_health_score"),
    ).filter("total_vehicles > 0").withColumn("event_date", F.lit(w.params.today))


def fleet_trend(w, days: int = 30, customer: str | None = None) -> DataFrame:
    per_vehicle = of_customer(recent(w, days), customer).filter(is_open()).groupBy("event_date", "uniqueid").agg(
        F.max(F.when(is_severe(), 1)).alias("severe"), F.sum("vehicle_health_score").alias("s"), F.count("*").alias("n"))
    return per_vehicle.groupBy("event_date").agg(
        F.count("*").alias("active_fault_vehicles"), F.count("severe").alias("critical_fault_vehicles"),
        (F.sum("s") / F.sum("n")).alias("fleet_health_score")).orderBy("event_date")


def top_risk_vehicles(w, limit: int = 20, customer: str | None = None) -> DataFrame:
    """The ranking uses only the vehicle table, so the limit is taken before
    the joins and they see ``limit`` vehicles."""
    ranked = of_customer(w.vhs, customer).filter("active_fault_count > 0").orderBy(
        F.desc("critical_fault_count"), "vehicle_health_score", F.desc("active_fault_count"), "uniqueid").limit(int(limit))
    ages = (
        w.vfm.filter(is_open()).join(ranked.select("uniqueid"), "uniqueid", "left_semi")
        .groupBy("uniqueid").agg(F.max(_age_days(w)).alias("age"))
    )
    models = w.vm.select("uniqueid", "model")
    return ranked.join(models, "uniqueid", "left").join(ages, "uniqueid", "left").select(
        "uniqueid", "vehicle_number", F.coalesce("model", F.lit("")).alias("vehicle_model"), "customer_name",
        F.col("vehicle_health_score").alias("health_score"), "active_fault_count", "critical_fault_count",
        F.coalesce("age", F.lit(0)).alias("longest_active_days"),
    ).orderBy(F.desc("critical_fault_count"), "health_score", F.desc("active_fault_count"), "uniqueid")


def _per_code_vehicle(df: DataFrame) -> DataFrame:
    return df.groupBy("dtc_code", "uniqueid").agg(
        F.sum("occurrence_count").alias("occ"), F.sum(F.col("resolution_time_sec") / 86400.0).alias("days"),
        F.count("*").alias("n"))


def dtc_summary(w, days: int = 30, limit: int = 15, customer: str | None = None) -> DataFrame:
    return _per_code_vehicle(of_customer(recent(w, days), customer)).groupBy("dtc_code").agg(
        F.sum("occ").alias("occurrences"), F.count("*").alias("vehicles_affected"),
        (F.sum("days") / F.sum("n")).alias("avg_persistence"),
    ).orderBy(F.desc("occurrences"), "dtc_code").limit(int(limit))


def top_dtc_codes(w, days: int = 30, limit: int = 10, customer: str | None = None) -> DataFrame:
    top = dtc_summary(w, days, limit, customer).drop("avg_persistence")
    names = w.dm.select("dtc_code", F.nullif("description", F.lit("")).alias("description"))
    return top.join(names, "dtc_code", "left").select(
        "dtc_code", F.coalesce("description", F.concat(F.lit("DTC "), "dtc_code")).alias("description"),
        "occurrences", "vehicles_affected").orderBy(F.desc("occurrences"), "dtc_code")


def severity_breakdown(w, days: int = 30, customer: str | None = None) -> DataFrame:
    level = F.when(is_severe(), "Critical").when(F.col("severity_level") == 2, "Moderate").otherwise("Minor")
    counts = of_customer(recent(w, days), customer).groupBy(level.alias("level")).agg(F.count("*").alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("percentage", settle(F.col("count") / total * 100, 1)).orderBy(F.desc("count"), "level")


def dtc_trend(w, dtc_code: str, days: int = 30, customer: str | None = None) -> DataFrame:
    return of_customer(recent(w, days), customer).filter(F.col("dtc_code") == dtc_code).groupBy("event_date").agg(
        F.sum("occurrence_count").alias("occurrences")).orderBy("event_date")


def dtc_alerts_trend(w, days: int = 30, customer: str | None = None) -> DataFrame:
    return of_customer(recent(w, days), customer).groupBy("event_date").agg(
        F.sum("occurrence_count").alias("total_alerts"), count_where(is_severe()).alias("critical_alerts"),
    ).orderBy("event_date")


def _worst_first(*key: str) -> list:
    return [F.desc("active_episodes"), F.desc("max_severity"), F.desc("episode_count"), *key]


def dtc_affected_vehicles(w, dtc_code: str, limit: int = 100, customer: str | None = None) -> DataFrame:
    return of_customer(w.vfm, customer).filter(F.col("dtc_code") == dtc_code).groupBy("uniqueid").agg(
        F.count("*").alias("episode_count"), count_where(is_open()).alias("active_episodes"),
        F.max("severity_level").alias("max_severity")).orderBy(*_worst_first("uniqueid")).limit(int(limit))


def selected_dtc_kpis(w, dtc_code: str, days: int = 30, customer: str | None = None) -> DataFrame:
    lasted = (F.col("is_resolved") == 1) & (F.col("resolution_time_sec") > 0)
    per_vehicle = of_customer(recent(w, days), customer).filter(F.col("dtc_code") == dtc_code).groupBy("uniqueid").agg(
        F.min("system").alias("system"), F.min("subsystem").alias("subsystem"), count_where(is_open()).alias("open"),
        count_where(is_open() & is_severe()).alias("critical"), F.count("*").alias("n"),
        F.sum(F.when(lasted, F.col("resolution_time_sec") / 86400.0)).alias("days"), count_where(lasted).alias("lasted"),
        count_where(F.col("driver_related") == 1).alias("driver"), F.max("event_date").alias("seen"))
    return per_vehicle.agg(
        F.min("system").alias("system"), F.min("subsystem").alias("subsystem"), F.count("*").alias("affected_vehicles"),
        F.sum("open").alias("active_episodes"), F.sum("critical").alias("critical_episodes"),
        settle(F.coalesce(F.try_divide(F.sum("days"), F.sum("lasted")), F.lit(0.0)), 1).alias("avg_resolution_days"),
        settle(F.try_divide(F.sum("driver"), F.sum("n")), 3).alias("driver_related_ratio"),
        F.max("seen").alias("last_seen_date"),
    ).filter("affected_vehicles > 0").withColumn("dtc_code", F.lit(dtc_code))


def selected_dtc_weekly_trend(w, dtc_code: str, days: int = 56, customer: str | None = None) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "event_date"))
    per_vehicle = of_customer(recent(w, days), customer).filter(F.col("dtc_code") == dtc_code).groupBy(
        week.alias("week_start"), "uniqueid").agg(
        F.sum("occurrence_count").alias("occ"), count_where(is_open()).alias("open"),
        count_where(is_open() & is_severe()).alias("critical"))
    return per_vehicle.groupBy("week_start").agg(
        F.sum("occ").alias("occurrences"), F.count("*").alias("affected_vehicles"),
        F.sum("open").alias("active_episodes"), F.sum("critical").alias("critical_episodes")).orderBy("week_start")


def _other_codes(faults: DataFrame, dtc_code: str, code_name: str) -> DataFrame:
    """Other codes of the vehicles that show ``dtc_code`` among ``faults``."""
    per = faults.groupBy("uniqueid", "dtc_code").agg(F.count("*").alias("n"))
    having = per.filter(F.col("dtc_code") == dtc_code).select("uniqueid")
    return per.filter(F.col("dtc_code") != dtc_code).join(having, "uniqueid", "left_semi").groupBy(
        F.col("dtc_code").alias(code_name)).agg(
        F.sum("n").alias("cooccurrence_count"), F.count("*").alias("vehicles_affected"))


def selected_dtc_cooccurrence(
    w, dtc_code: str, days: int = 30, limit: int = 10, customer: str | None = None,
) -> DataFrame:
    return _other_codes(of_customer(recent(w, days), customer), dtc_code, "co_dtc_code").orderBy(
        F.desc("vehicles_affected"), F.desc("cooccurrence_count"), "co_dtc_code").limit(int(limit))


def selected_dtc_vehicles(
    w, dtc_code: str, days: int = 90, limit: int = 100, customer: str | None = None,
) -> DataFrame:
    per_vehicle = of_customer(recent(w, days), customer).filter(F.col("dtc_code") == dtc_code).groupBy("uniqueid").agg(
        F.min("vehicle_number").alias("vehicle_number"), F.count("*").alias("episode_count"),
        count_where(is_open()).alias("active_episodes"), F.max("severity_level").alias("max_severity"),
        F.max("event_date").alias("last_reported_date")).orderBy(*_worst_first("uniqueid")).limit(int(limit))
    scores = w.vhs.select("uniqueid", "vehicle_health_score")
    return per_vehicle.join(scores, "uniqueid", "left").select(
        "uniqueid", F.coalesce(F.nullif("vehicle_number", F.lit("")), F.col("uniqueid")).alias("vehicle_number"),
        "episode_count", "active_episodes", "max_severity", "last_reported_date",
        settle(F.coalesce("vehicle_health_score", F.lit(0.0)), 1).alias("health_score"),
    ).orderBy(*_worst_first("uniqueid"))


def vehicles_with_dtcs(w, limit: int = 50, customer: str | None = None) -> DataFrame:
    """The limit is taken on the vehicle table, whose counts already say that
    an open episode exists; only those vehicles' codes are gathered."""
    ranked = of_customer(w.vhs, customer).filter("active_fault_count > 0").orderBy(
        F.desc("critical_fault_count"), F.desc("active_fault_count"), "uniqueid").limit(int(limit))
    codes = (
        w.vfm.filter(is_open()).join(ranked.select("uniqueid"), "uniqueid", "left_semi")
        .groupBy("uniqueid", "dtc_code").agg(F.max("event_date").alias("d"))
        .groupBy("uniqueid").agg(F.sort_array(F.collect_list("dtc_code")).alias("dtc_codes"),
                                 F.max("d").alias("last_reported"))
    )
    status = F.when(F.col("critical_fault_count") > 0, "Critical").when(
        F.col("active_fault_count") > 0, "Active").otherwise("Normal")
    return ranked.join(codes, "uniqueid").select(
        "uniqueid", "vehicle_number", "customer_name", "dtc_codes", status.alias("status"), "last_reported",
        F.col("active_fault_count").alias("active_count"), F.col("critical_fault_count").alias("critical_count"),
    ).orderBy(F.desc("critical_count"), F.desc("active_count"), "uniqueid")


def vehicle_overview(w, uniqueid: str) -> DataFrame:
    models = w.vm.filter(F.col("uniqueid") == uniqueid).select("uniqueid", "model", "vehicle_type")
    return w.vhs.filter(F.col("uniqueid") == uniqueid).join(models, "uniqueid", "left").select(
        "uniqueid", "vehicle_number", F.coalesce("model", F.lit("")).alias("vehicle_model"),
        F.coalesce("vehicle_type", F.lit("")).alias("vehicle_type"), "customer_name",
        F.col("vehicle_health_score").alias("health_score"), "active_fault_count", "critical_fault_count").limit(1)


def vehicle_faults(w, uniqueid: str, days: int = 90, limit: int = 200, customer: str | None = None) -> DataFrame:
    return of_customer(recent(w, days), customer).filter(F.col("uniqueid") == uniqueid).groupBy("dtc_code").agg(
        F.count("*").alias("episode_count"), count_where(is_open()).alias("active_episodes"),
        F.max("severity_level").alias("max_severity"), F.max(_age_days(w)).alias("days_persistence"),
    ).orderBy(*_worst_first("dtc_code")).limit(int(limit))


def vehicle_timeline(w, uniqueid: str, days: int = 90, customer: str | None = None) -> DataFrame:
    return of_customer(recent(w, days), customer).filter(F.col("uniqueid") == uniqueid).groupBy("event_date").agg(
        count_where(is_open()).alias("active_episodes"), count_where(is_open() & is_severe()).alias("critical_episodes"),
    ).orderBy("event_date")


def customer_overview(w, limit: int = 50) -> DataFrame:
    name = F.coalesce(F.nullif("customer_name", F.lit("")), F.lit("Unassigned"))
    return w.vhs.groupBy(name.alias("customer_name")).agg(
        F.count("*").alias("vehicle_count"), count_where(F.col("active_fault_count") > 0).alias("active_fault_vehicles"),
        count_where(F.col("critical_fault_count") > 0).alias("critical_fault_vehicles"),
        _mean(F.col("vehicle_health_score")).alias("avg_health_score"),
    ).orderBy(F.desc("vehicle_count"), "customer_name").limit(int(limit))


def _top_maintenance(w, limit: int, customer: str | None) -> DataFrame:
    return of_customer_vehicles(w, w.maintenance, customer).orderBy(
        F.desc("maintenance_priority_score"), "uniqueid", "dtc_code").limit(int(limit))


def _action(col: str = "recommended_action") -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(DEFAULT_ACTION))


def maintenance_recommendations(w, limit: int = 20, customer: str | None = None) -> DataFrame:
    return _top_maintenance(w, limit, customer).join(w.dm.select("dtc_code", "subsystem"), "dtc_code", "left").orderBy(
        F.desc("maintenance_priority_score"), "uniqueid", "dtc_code").select(
        "uniqueid", "dtc_code", "severity_level", F.coalesce("subsystem", F.lit("")).alias("subsystem"),
        _action().alias("recommendation"))


def fleet_health_snap(w, customer: str | None = None) -> DataFrame:
    """Totals over tenants; the leading code, system and trend come from the
    tenant with most active vehicles (ties: the smallest tenant)."""
    rank = F.struct(-F.col("vehicles_with_active_faults"), F.col("clientLoginId"))
    pick = lambda c: F.min_by(c, F.when(F.col(c) != "", rank))
    weight = F.col("total_vehicles").cast("double")
    return of_customer_tenants(w, w.fhs, customer).agg(
        F.sum("total_vehicles").alias("total_vehicles"),
        F.sum("vehicles_with_active_faults").alias("vehicles_with_active_faults"),
        F.sum("vehicles_with_critical_faults").alias("vehicles_with_critical_faults"),
        F.sum("driver_related_faults").alias("driver_related_faults"),
        settle(F.coalesce(F.try_divide(F.sum(F.col("fleet_health_score") * weight), F.sum(weight)), F.lit(100.0)), 2)
        .alias("fleet_health_score"),
        F.coalesce(pick("most_common_dtc"), F.lit("")).alias("most_common_dtc"),
        F.coalesce(pick("most_common_system"), F.lit("")).alias("most_common_system"),
        F.coalesce(F.min_by("active_fault_trend", rank), F.lit("stable")).alias("active_fault_trend"),
    ).filter("total_vehicles > 0")


def fleet_system_health(w, customer: str | None = None) -> DataFrame:
    name = F.when(F.col("system").isin("", "nan"), "other").otherwise(F.col("system"))
    return of_customer_tenants(w, w.systems, customer).groupBy(name.alias("system")).agg(
        F.sum("vehicles_affected").alias("vehicles_affected"), F.sum("active_faults").alias("active_faults"),
        F.sum("critical_faults").alias("critical_faults"), settle(F.avg("risk_score"), 2).alias("risk_score"),
        F.min("trend").alias("trend")).orderBy(F.desc("risk_score"), "system")


def fleet_fault_trends(w, days: int = 30, customer: str | None = None) -> DataFrame:
    return of_customer_tenants(w, recent(w, days, w.trends, "date"), customer).groupBy(
        F.col("date").alias("event_date")).agg(
        F.sum("active_faults").alias("active_faults"), F.sum("new_faults").alias("new_faults"),
        F.sum("resolved_faults").alias("resolved_faults"), F.sum("driver_related_faults").alias("driver_related_faults"),
        settle(F.avg("fleet_health_score"), 2).alias("fleet_health_score")).orderBy("event_date")


def dtc_fleet_impact(w, limit: int = 20) -> DataFrame:
    return w.impact.groupBy("dtc_code").agg(
        F.min("system").alias("system"), F.min("subsystem").alias("subsystem"),
        F.sum("vehicles_affected").alias("vehicles_affected"), F.sum("active_vehicles").alias("active_vehicles"),
        settle(F.avg("avg_resolution_time"), 1).alias("avg_resolution_time"),
        settle(F.avg("driver_related_ratio"), 3).alias("driver_related_ratio"),
        settle(F.avg("fleet_risk_score"), 2).alias("fleet_risk_score"),
    ).orderBy(F.desc("fleet_risk_score"), "dtc_code").limit(int(limit))


def dtc_cooccurrence(w, limit: int = 20) -> DataFrame:
    return w.cooccurrence.groupBy("dtc_code_a", "dtc_code_b").agg(
        F.sum("cooccurrence_count").alias("cooccurrence_count"), F.sum("vehicles_affected").alias("vehicles_affected"),
        settle(F.avg("avg_time_gap_sec"), 1).alias("avg_time_gap_sec"),
    ).orderBy(F.desc("cooccurrence_count"), "dtc_code_a", "dtc_code_b").limit(int(limit))


def dtc_detail(w, dtc_code: str) -> DataFrame:
    # a stored severity of 0 reads as 1 here
    severity = F.when(F.col("severity_level") == 0, 1).otherwise(F.col("severity_level"))
    return w.dm.filter(F.col("dtc_code") == dtc_code).select(
        "dtc_code", "system", "subsystem", "description", severity.alias("severity_level"), "primary_cause", "symptoms",
        "impact_if_unresolved", "fuel_mileage_impact", "action_required", "repair_complexity",
        "estimated_repair_hours", (F.col("driver_related") != 0).alias("driver_related"),
        "driver_behaviour_category", "recommended_preventive_action").limit(1)


def vehicle_health_detail(w, uniqueid: str) -> DataFrame:
    flags = [(F.col(f"has_{n}_issue") != 0).alias(f"has_{n}_issue")
             for n in ("engine", "emission", "safety", "electrical")]
    return w.vhs.filter(F.col("uniqueid") == uniqueid).select(
        "uniqueid", "vehicle_number", "customer_name", "vehicle_health_score", "active_fault_count",
        "critical_fault_count", "total_episodes", "episodes_last_30_days",
        settle("avg_resolution_time", 1).alias("avg_resolution_time"), "driver_related_faults", "most_common_dtc",
        *flags).limit(1)


def enhanced_maintenance(w, limit: int = 30, customer: str | None = None) -> DataFrame:
    return _top_maintenance(w, limit, customer).select(
        "uniqueid", "vehicle_number", "dtc_code", "description", "severity_level", "fault_duration_sec",
        "episodes_last_30_days", settle("maintenance_priority_score", 1).alias("maintenance_priority_score"),
        _action().alias("recommended_action"))
