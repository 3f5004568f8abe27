"""Output checks and filter options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKED = (
    "dtc_events_exploded", "vehicle_fault_master", "fleet_health_summary", "fleet_fault_trends",
    "vehicle_health_summary", "dtc_fleet_impact")
MUST_HAVE_ROWS = ("dtc_events_exploded", "vehicle_fault_master")

UNIQUE_KEYS = {
    "vehicle_fault_master": ("episode_id",), "fleet_health_summary": ("clientLoginId",),
    "vehicle_health_summary": ("clientLoginId", "uniqueid"), "dtc_fleet_impact": ("clientLoginId", "dtc_code"),
    "fleet_fault_trends": ("clientLoginId", "date"),
}


def output_counts(tables: Mapping[str, DataFrame], names: Sequence[str] = CHECKED) -> DataFrame:
    counts = [tables[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    return reduce(DataFrame.unionByName, counts)


def duplicate_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = UNIQUE_KEYS) -> DataFrame:
    """Number of keys with more than one row, per table."""
    checks = [
        tables[n].groupBy(*k).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicates"))
        .select(F.lit(n).alias("table_name"), "duplicates") for n, k in keys.items() if n in tables]
    return reduce(DataFrame.unionByName, checks)


def shared_vehicles(vehicles: DataFrame) -> DataFrame:
    """Vehicles that belong to more than one tenant. Episodes are found per
    vehicle and code, so such a vehicle would be counted once per tenant."""
    pairs = vehicles.select("uniqueid", "clientLoginId").distinct()
    return pairs.groupBy("uniqueid").agg(F.count("*").alias("tenants")).filter("tenants > 1")


def validate_outputs(tables: Mapping[str, DataFrame], vehicles: DataFrame | None = None) -> dict[str, int]:
    """Row counts of the checked outputs; raises when a check fails."""
    counts = {r["table_name"]: r["rows"] for r in output_counts(tables).collect()}
    for name in MUST_HAVE_ROWS:
        if counts[name] == 0:
            raise ValueError(f"{name} is empty")
    for r in duplicate_keys(tables).filter("duplicates > 0").collect():
        raise ValueError(f"{r['table_name']} has {r['duplicates']} duplicate keys")
    if vehicles is not None and not shared_vehicles(vehicles).isEmpty():
        raise ValueError("a vehicle belongs to more than one tenant")
    return counts


def distinct_filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(option, value): the non-empty values of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value <> ''").distinct().orderBy("option", "value")
