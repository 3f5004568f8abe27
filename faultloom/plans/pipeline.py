"""The batch pipeline: dimensions, events, fault master, eight tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultloom.operators import quality, rollups
from faultloom.operators.episodes import resolved_episodes
from faultloom.operators.events import events_exploded
from faultloom.operators.fault_master import fault_master_from_stored
from faultloom.params import Params
from faultloom.session import run_folder
from faultloom.sources.readers import build_dtc_master, build_vehicle_master, engine_cycle_seconds, resolve_vehicle_profile
from faultloom.sources.writers import layouts, write_partitioned

OUTPUT_TABLES = (
    "dtc_events_exploded", "vehicle_fault_master", "fleet_health_summary", "fleet_dtc_distribution",
    "fleet_system_health", "fleet_fault_trends", "vehicle_health_summary", "dtc_fleet_impact",
    "maintenance_priority", "dtc_cooccurrence",
)


class Warehouse:
    """The analytics tables of one run.

    A table is computed and written to the run's folder when it is first
    asked for, with its partition and sort layout, and read back from there:
    queries prune columns and partitions, and a lost executor costs a re-read
    instead of a re-run of the pipeline.
    """

    def __init__(
        self, spark: SparkSession, *, history: DataFrame, cycles: DataFrame, profile: DataFrame,
        codes: DataFrame, params: Params, folder: str | None = None,
    ):
        self.spark, self.params = spark, params
        self.folder = folder or run_folder(spark)
        self.history = history
        self.profile = resolve_vehicle_profile(profile)
        self.codes = codes
        self._tables: dict[str, DataFrame] = {}
        self._builders: dict[str, Callable[[], DataFrame]] = {
            # stored: the episodes read them as rows, as carried rows and as the last one of a vehicle
            "engine_cycles": lambda: engine_cycle_seconds(cycles),
            "vehicle_master": lambda: build_vehicle_master(self.profile),
            "dtc_master": lambda: build_dtc_master(self.codes),
            "dtc_events_exploded": lambda: events_exploded(self.history, self.vm, self.params),
            "fault_episodes": lambda: resolved_episodes(self.events, self.cycles, self.params),
            # stored episodes: risk and fault rows both read them, and a failure later on does not repeat their making
            "vehicle_fault_master": lambda: fault_master_from_stored(
                self.table("fault_episodes"), self.vm, self.dm, self.params),
            "vehicle_code_stats": lambda: rollups.vehicle_code_stats(self.vfm, self.params),
            "fleet_health_summary": lambda: rollups.fleet_health_summary(self.stats, self.vm, self.params),
            "fleet_dtc_distribution": lambda: rollups.fleet_dtc_distribution(self.stats),
            "fleet_system_health": lambda: rollups.fleet_system_health(self.stats),
            "fleet_fault_trends": lambda: rollups.fleet_fault_trends(self.vfm, self.params),
            "vehicle_health_summary": lambda: rollups.vehicle_health_summary(self.stats, self.vm, self.params),
            "dtc_fleet_impact": lambda: rollups.dtc_fleet_impact(self.stats),
            "maintenance_priority": lambda: rollups.maintenance_priority(self.vfm, self.stats, self.dm),
            "dtc_cooccurrence": lambda: rollups.dtc_cooccurrence(self.stats),
        }

    def build(self, name: str) -> DataFrame:
        """The table's plan, not written anywhere."""
        return self._builders[name]()

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.folder}/{name}"
            write_partitioned(self.build(name), path, layouts().get(name))
            self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]

    def take(self, name: str, df: DataFrame) -> Warehouse:
        """Use a table that is already stored elsewhere."""
        self._tables[name] = df
        return self

    def run(self) -> dict[str, DataFrame]:
        """Build every output table."""
        return {name: self.table(name) for name in OUTPUT_TABLES}

    def validate(self) -> dict[str, int]:
        """Row counts of the checked outputs; raises when a check fails."""
        names = {*quality.CHECKED, *quality.UNIQUE_KEYS}
        return quality.validate_outputs({n: self.table(n) for n in names}, self.vm)

    cycles = property(lambda self: self.table("engine_cycles"))
    vm = property(lambda self: self.table("vehicle_master"))
    dm = property(lambda self: self.table("dtc_master"))
    events = property(lambda self: self.table("dtc_events_exploded"))
    vfm = property(lambda self: self.table("vehicle_fault_master"))
    stats = property(lambda self: self.table("vehicle_code_stats"))
    fhs = property(lambda self: self.table("fleet_health_summary"))
    distribution = property(lambda self: self.table("fleet_dtc_distribution"))
    systems = property(lambda self: self.table("fleet_system_health"))
    trends = property(lambda self: self.table("fleet_fault_trends"))
    vhs = property(lambda self: self.table("vehicle_health_summary"))
    impact = property(lambda self: self.table("dtc_fleet_impact"))
    maintenance = property(lambda self: self.table("maintenance_priority"))
    cooccurrence = property(lambda self: self.table("dtc_cooccurrence"))
