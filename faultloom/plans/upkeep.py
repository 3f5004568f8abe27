"""The roll-up tables brought forward with the fault table, rewriting only what changed.

``run_incremental`` notes, before it touches the fault table, which vehicles it
recomputes and what their days looked like. ``keep_rollups`` takes these notes
and recomputes the units they can have changed:

* a vehicle in ``vehicle_code_stats``, ``vehicle_health_summary``, ``maintenance_priority``,
* a tenant's code in ``fleet_dtc_distribution`` and ``dtc_fleet_impact``, a tenant in
  ``fleet_health_summary`` and ``fleet_system_health``, an anchor code in
  ``dtc_cooccurrence``, where a row of the vehicles' statistics differs from the stored one,
* a tenant's day in ``fleet_fault_trends``, where a vehicle's fault rows of that day differ.

Vehicles without new rows count too when one of their episodes leaves the last
7, 14 or 30 days. Tables are stored in buckets of a key (days: in months), and
a bucket without a changed unit keeps its files.

Statistics are written last and notes are dropped after them, so a call that
fails is repeated by the next one with the same differences in sight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from faultloom.operators import rollups
from faultloom.params import Params
from faultloom.session import run_folder
from faultloom.sources import writers
from faultloom.sources.writers import Layout

ROLLUPS = (
    "fleet_dtc_distribution", "dtc_fleet_impact", "fleet_system_health", "fleet_health_summary", "fleet_fault_trends",
    "dtc_cooccurrence", "maintenance_priority", "vehicle_health_summary", "vehicle_code_stats",
)
DAY_KEYS = ("uniqueid", "clientLoginId", "event_date")


def bucketed(buckets: int) -> dict[str, Layout]:
    """Stored layout of every roll-up: its bucket column and sort keys."""
    by = lambda key, *sort: Layout("bucket", F.pmod(F.xxhash64(key), F.lit(int(buckets))).cast("int"), sort)
    return {
        "fleet_dtc_distribution": by("dtc_code", "clientLoginId", "dtc_code"),
        "dtc_fleet_impact": by("dtc_code", "dtc_code", "clientLoginId"),
        "fleet_system_health": by("clientLoginId", "clientLoginId", "system"),
        "fleet_health_summary": by("clientLoginId", "clientLoginId"),
        "fleet_fault_trends": writers.layouts()["fleet_fault_trends"],
        "dtc_cooccurrence": by("dtc_code_a", "dtc_code_a", "dtc_code_b"),
        "maintenance_priority": by("uniqueid", "uniqueid", "dtc_code"),
        "vehicle_health_summary": by("uniqueid", "uniqueid"),
        "vehicle_code_stats": by("uniqueid", "uniqueid", "dtc_code"),
    }


def _joined(df: DataFrame, units: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on all columns of ``units``; nulls are equal."""
    u = units.select(*[F.col(c).alias(f"_u_{c}") for c in units.columns])
    return df.join(u, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in units.columns]), how)


def among(df: DataFrame, units: DataFrame) -> DataFrame:
    return _joined(df, units, "left_semi")


def apart(df: DataFrame, units: DataFrame) -> DataFrame:
    return _joined(df, units, "left_anti")


def day_digests(vfm: DataFrame, ids: DataFrame) -> DataFrame:
    """What the daily trend sees of the given vehicles: a digest per vehicle, tenant and day."""
    seen = F.xxhash64("episode_id", "is_resolved", "severity_level", "driver_related")
    return among(vfm, ids).groupBy(*DAY_KEYS).agg(F.sum(seen.cast("decimal(38,0)")).alias("digest"))


def note_changes(spark: SparkSession, folder: str, vfm: DataFrame, ids: DataFrame) -> None:
    """Vehicles about to be recomputed, kept until the roll-ups have taken them; nothing where none are kept."""
    if not writers.exists(spark, f"{folder}/rollup_log") or ids.isEmpty():
        return
    run = "r" + run_folder(spark).rsplit("/", 1)[1]
    day_digests(vfm, ids).write.parquet(f"{folder}/rollup_notes/days/run={run}")
    ids.write.parquet(f"{folder}/rollup_notes/ids/run={run}")


def changed_days(notes: DataFrame, now: DataFrame, runs: int) -> DataFrame:
    """(clientLoginId, date) that some vehicle shows otherwise than every one of the noted runs saw it."""
    before = notes.groupBy(*DAY_KEYS, "digest").agg(F.count_distinct("run").alias("runs"))
    a, b = before.alias("a"), now.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*DAY_KEYS, "digest")])
    key = lambda c: F.when(F.col("a.digest").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    other = F.col("a.digest").isNull() | F.col("b.digest").isNull() | (F.col("a.runs") != runs)
    return a.join(b, same, "full_outer").filter(other).select(key("clientLoginId").alias("clientLoginId"), key("event_date").alias("date")).distinct()


def drifted(vfm: DataFrame, old: Params, new: Params) -> DataFrame:
    """Vehicles with an episode that crossed a border of the last 7, 14 or 30 days between two run times."""
    first, last = sorted((old, new), key=lambda p: p.as_of)
    crossed = (F.col("first_ts") >= first.thirty_days_ago_ts) & (F.col("first_ts") < last.thirty_days_ago_ts)
    for n in (7, 14):
        crossed |= (F.col("event_date") >= F.lit(first.days_ago(n))) & (F.col("event_date") < F.lit(last.days_ago(n)))
    return vfm.filter(crossed).select("uniqueid").distinct()


def replace_units(path: str, old: DataFrame, layout: Layout, units: DataFrame, fresh: DataFrame) -> None:
    """Replace the rows of the given units in the table ``old`` at ``path``; partitions that hold none of them keep their files."""
    spark = old.sparkSession
    staged, part = run_folder(spark), layout.partition
    values = lambda df: {r[0] for r in df.select(layout.partition_expr.alias(part)).distinct().collect()}  # noqa: E731  buckets or months
    touched = values(units)
    if not touched:
        return
    columns = [c for c in old.columns if c != part]
    kept = apart(old.filter(F.col(part).isin(*touched)), units).select(*columns)
    writers.write_partitioned(kept.unionByName(fresh.select(*columns)), staged, layout)
    whole = spark.read.schema(old.schema).parquet(staged)
    left, had = values(whole), {r[0] for r in old.select(part).distinct().collect()}
    if left:
        writers.rebuild(whole.drop(part), path, layout, only_touched_partitions=True)
    for gone in (touched & had) - left:
        writers.drop_partition(spark, path, part, gone)


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either side that the other side lacks."""
    new = new.select(*old.columns)
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def _build(name: str, vfm: DataFrame, stats: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params) -> DataFrame:
    """A roll-up of the given fault rows, statistics and vehicles."""
    return {
        "vehicle_code_stats": lambda: rollups.vehicle_code_stats(vfm, params),
        "fleet_dtc_distribution": lambda: rollups.fleet_dtc_distribution(stats),
        "dtc_fleet_impact": lambda: rollups.dtc_fleet_impact(stats),
        "fleet_system_health": lambda: rollups.fleet_system_health(stats),
        "fleet_health_summary": lambda: rollups.fleet_health_summary(stats, vehicles, params),
        "fleet_fault_trends": lambda: rollups.fleet_fault_trends(vfm, params),
        "dtc_cooccurrence": lambda: rollups.dtc_cooccurrence(stats),
        "maintenance_priority": lambda: rollups.maintenance_priority(vfm, stats, codes),
        "vehicle_health_summary": lambda: rollups.vehicle_health_summary(stats, vehicles, params),
    }[name]()


def _together(spark: SparkSession, jobs: Iterable[Callable[[], None]]) -> None:
    """Run independent small jobs side by side; all end before the first error is raised."""
    with ThreadPoolExecutor(4) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in started:
        job.result()


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = run_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def keep_rollups(
    spark: SparkSession, folder: str, vfm: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params, buckets: int = 64,
) -> dict[str, DataFrame]:
    """The roll-ups of the fault table ``vfm`` that ``run_incremental`` keeps in ``folder`` at ``params.as_of``, by name.

    The first call, and one with other parameters or another number of buckets,
    builds them whole. ``buckets`` should keep a bucket of vehicles at a few
    hundred MB. ``vehicles`` and ``codes`` are the masters that the fault table
    was brought forward with; an empty fault table gives empty tables.
    """
    layouts, log = bucketed(buckets), f"{folder}/rollup_log"
    signature = f"{replace(params, as_of=0)} {int(buckets)}"
    path = lambda name: f"{folder}/{name}"
    table = lambda name: spark.read.schema(schemas[name]).parquet(path(name))
    read = lambda name: table(name).drop(layouts[name].partition)
    last = spark.read.parquet(log).orderBy(F.desc("n")).first() if writers.exists(spark, log) else None
    notes = f"{folder}/rollup_notes"
    noted = writers.exists(spark, f"{notes}/ids")
    ids = spark.read.parquet(f"{notes}/ids") if noted else spark.createDataFrame([], "uniqueid string, run string")
    runs = [r[0] for r in ids.select(F.col("run").cast("string")).distinct().collect()]  # runs since the last call

    # schema as written: a folder whose last partition went has no file to take it from
    stats_of = lambda rows: rollups.vehicle_code_stats(rows, params)
    stats = stats_of(vfm)
    schemas = {n: _build(n, vfm, stats, vehicles, codes, params).withColumn(layouts[n].partition, F.lit(0)).schema for n in ROLLUPS}
    if last is None or last["signature"] != signature:
        writers.write_partitioned(stats, path("vehicle_code_stats"), layouts["vehicle_code_stats"])
        stats = read("vehicle_code_stats")
        _together(
            spark, (lambda name=name: writers.write_partitioned(_build(name, vfm, stats, vehicles, codes, params), path(name), layouts[name])
                    for name in ROLLUPS[:-1]))
    else:
        touched = _stored(spark, ids.select("uniqueid").unionByName(drifted(vfm, replace(params, as_of=last["as_of"]), params)).distinct())
        before = read("vehicle_code_stats")
        fresh = _stored(spark, stats_of(among(vfm, touched)))
        stats = apart(before, touched).unionByName(fresh.select(*before.columns))
        differs = _stored(spark, _differing(among(before, touched), fresh).select("clientLoginId", "uniqueid", "dtc_code").distinct())
        homes = _differing(among(read("vehicle_health_summary").select("clientLoginId", "uniqueid"), touched),
                           among(vehicles, touched).select("clientLoginId", "uniqueid"))
        tenants = _stored(spark, differs.select("clientLoginId").unionByName(homes.select("clientLoginId")).distinct())
        tenant_codes = differs.select("clientLoginId", "dtc_code").distinct()
        # a vehicle's episodes and tenant stand in the pairs of all its codes
        affected = differs.select("uniqueid").distinct()
        anchors = _stored(spark, among(before, affected).select("dtc_code").unionByName(among(fresh, affected).select("dtc_code")).distinct())
        showing = among(stats, anchors).select("uniqueid").distinct()
        if runs:
            days = _stored(spark, changed_days(
                spark.read.parquet(f"{notes}/days"), day_digests(vfm, ids.select("uniqueid").distinct()), len(runs)))
        else:
            days = spark.createDataFrame([], "clientLoginId string, date date")
        on_days = among(vfm, days.withColumnRenamed("date", "event_date"))
        units: dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {
            "fleet_dtc_distribution": (tenant_codes, vfm, among(stats, tenant_codes), vehicles),
            "dtc_fleet_impact": (tenant_codes, vfm, among(stats, tenant_codes), vehicles),
            "fleet_system_health": (tenants, vfm, among(stats, tenants), vehicles),
            "fleet_health_summary": (tenants, vfm, among(stats, tenants), among(vehicles, tenants)),
            "fleet_fault_trends": (days, on_days, stats, vehicles),
            "dtc_cooccurrence": (anchors.withColumnRenamed("dtc_code", "dtc_code_a"), vfm, among(stats, showing), vehicles),
            "maintenance_priority": (touched, among(vfm, touched), fresh, vehicles),
            "vehicle_health_summary": (touched, vfm, fresh, among(vehicles, touched)),
        }

        def bring_forward(name: str) -> None:
            unit, rows, of_units, vm = units[name]
            fresh_units = among(_build(name, rows, of_units, vm, codes, params), unit)
            replace_units(path(name), table(name), layouts[name], unit, fresh_units)

        _together(spark, (lambda name=name: bring_forward(name) for name in units))
        replace_units(path("vehicle_code_stats"), table("vehicle_code_stats"), layouts["vehicle_code_stats"], touched, fresh)
    n = 0 if last is None else last["n"] + 1
    entry = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(params.as_of).cast("long").alias("as_of"), F.lit(signature).alias("signature"))
    writers.append(entry, log)
    for run in runs:
        for kind in ("days", "ids"):
            writers.drop_partition(spark, f"{notes}/{kind}", "run", run)
    return {name: read(name) for name in ROLLUPS}
