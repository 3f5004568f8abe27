"""The table catalogue that questions and logged queries are checked against."""

from __future__ import annotations

from typing import NamedTuple


class Entry(NamedTuple):
    table: str
    description: str
    columns: tuple[str, ...]
    use_cases: tuple[str, ...]
    priority: str


# fixed values: table, description, columns, use cases, priority
CATALOGUE = (
    Entry("vehicle_fault_master", "Fault episodes per vehicle with severity, resolution, and customer scope",
          ("uniqueid", "vehicle_number", "customer_name", "dtc_code", "system", "subsystem",
           "severity_level", "first_ts", "last_ts", "event_date", "occurrence_count", "resolution_time_sec",
           "is_resolved", "driver_related", "vehicle_health_score"),
          ("vehicle faults", "fault history", "root cause", "cooccurrence", "fault frequency", "severity"), "raw"),
    Entry("fleet_dtc_distribution", "Pre-aggregated fleet DTC distribution and impact metrics",
          ("dtc_code", "description", "system", "subsystem", "severity_level", "vehicles_affected",
           "active_vehicles", "total_occurrences", "total_episodes", "avg_resolution_time",
           "driver_related_count"),
          ("top dtc", "fleet distribution", "fleet dtc", "common dtc"), "aggregated"),
    Entry("fleet_health_summary", "Fleet-wide summary KPIs",
          ("total_vehicles", "vehicles_with_active_faults", "vehicles_with_critical_faults",
           "driver_related_faults", "fleet_health_score", "most_common_dtc", "most_common_system",
           "active_fault_trend"),
          ("fleet health", "fleet overview", "kpi", "summary"), "aggregated"),
    Entry("fleet_fault_trends", "Daily trend series for fleet faults and health",
          ("date", "active_faults", "new_faults", "resolved_faults", "driver_related_faults",
           "fleet_health_score"),
          ("trend", "time series", "daily", "over time"), "aggregated"),
    Entry("fleet_system_health", "Fleet risk and fault metrics by system",
          ("system", "vehicles_affected", "active_faults", "critical_faults", "risk_score", "trend"),
          ("system health", "risk by system", "engine issues", "emission issues"), "aggregated"),
    Entry("vehicle_health_summary", "Vehicle-level health summary and issue flags",
          ("uniqueid", "vehicle_number", "customer_name", "vehicle_health_score", "active_fault_count",
           "critical_fault_count", "total_episodes", "episodes_last_30_days", "avg_resolution_time",
           "driver_related_faults", "most_common_dtc", "has_engine_issue", "has_emission_issue",
           "has_safety_issue", "has_electrical_issue"),
          ("vehicle health", "vehicle summary", "maintenance", "critical faults"), "aggregated"),
    Entry("maintenance_priority", "Pre-ranked maintenance priorities by vehicle and fault",
          ("uniqueid", "vehicle_number", "dtc_code", "description", "severity_level", "fault_duration_sec",
           "episodes_last_30_days", "maintenance_priority_score", "recommended_action"),
          ("maintenance priority", "urgent maintenance", "action plan"), "aggregated"),
    Entry("dtc_fleet_impact", "Fleet impact metrics by DTC code",
          ("dtc_code", "system", "subsystem", "vehicles_affected", "active_vehicles", "avg_resolution_time",
           "driver_related_ratio", "fleet_risk_score"),
          ("dtc impact", "risk score", "fleet risk"), "aggregated"),
    Entry("dtc_cooccurrence", "Co-occurrence pairs for DTC codes",
          ("dtc_code_a", "dtc_code_b", "cooccurrence_count", "vehicles_affected", "avg_time_gap_sec",
           "last_seen_ts"),
          ("cooccurrence", "fault correlation", "root cause pattern"), "aggregated"),
    Entry("dtc_master", "Reference DTC knowledge base",
          ("dtc_code", "system", "subsystem", "description", "primary_cause", "secondary_causes",
           "symptoms", "impact_if_unresolved", "severity_level", "safety_risk_level", "action_required",
           "recommended_preventive_action"),
          ("dtc details", "symptoms", "causes", "repair guidance"), "dimension"),
)

# fixed values: tables offered when no table scores
DEFAULT_TABLES = ("fleet_health_summary", "fleet_dtc_distribution", "vehicle_health_summary", "vehicle_fault_master")

# fixed values: tables a logged query may read
ALLOWED_TABLES = (
    "dtc_master", "vehicle_master", "dtc_events_exploded", "vehicle_fault_master", "fleet_health_summary",
    "fleet_dtc_distribution", "fleet_system_health", "fleet_fault_trends", "vehicle_health_summary",
    "dtc_fleet_impact", "maintenance_priority", "dtc_cooccurrence",
)
