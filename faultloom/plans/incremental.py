"""Change windows, checkpoints, impacted-vehicle rebuilds and trace sync."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.operators.episodes import resolved_episodes
from faultloom.operators.events import events_exploded
from faultloom.operators.fault_master import FAULT_COLUMNS, fault_master_from_episodes, vehicle_fault_master
from faultloom.params import DAY, Params
from faultloom.plans.upkeep import keep_rollups, note_changes
from faultloom.session import run_folder, stored
from faultloom.sources import writers
from faultloom.sources.readers import _filled, latest_by_key, within


@dataclass(frozen=True)
class Window:
    since_ts: int
    until_ts: int


def cdc_window(
    checkpoints: DataFrame | None, pipeline: str, as_of: int, replay_hours: int = 1, bootstrap_days: int = 90,
) -> Window:
    """First run: the bootstrap window. Later: from the checkpoint minus the replay hours."""
    last = None
    if checkpoints is not None:
        last = checkpoints.filter(F.col("pipeline") == pipeline).agg(F.max("checkpoint_ts")).first()[0]
    since = as_of - bootstrap_days * DAY if last is None else last - replay_hours * 3600
    return Window(since, as_of)


def current_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return latest_by_key(checkpoints, ["pipeline"], ["updated_at"])


def record_run(spark, folder: str, pipeline: str, window: Window, rows: int, status: str = "ok") -> None:
    """One log row per run; the checkpoint moves only after a successful run."""
    run = spark.range(1).select(
        F.lit(pipeline).alias("pipeline"), F.lit(window.since_ts).cast("long").alias("since_ts"),
        F.lit(window.until_ts).cast("long").alias("until_ts"), F.lit(rows).cast("long").alias("rows"),
        F.lit(status).alias("status"), F.lit(window.until_ts).cast("long").alias("updated_at"))
    writers.append(run, f"{folder}/cdc_run_log")
    if status == "ok":
        writers.append(run.select("pipeline", F.col("until_ts").alias("checkpoint_ts"), "updated_at"),
                       f"{folder}/cdc_checkpoint")


def master_digests(vehicles: DataFrame, codes: DataFrame) -> DataFrame:
    """(kind, key, digest) of every vehicle and code of the master tables."""
    of = lambda df, kind, key: df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)]))).alias("digest"))
    return of(vehicles, "vehicle", "uniqueid").unionByName(of(codes, "code", "dtc_code"))


def changed_masters(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, key) that came, went or read otherwise between two snapshots."""
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, same, "full_outer").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(
        F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.key", "b.key").alias("key"))


def impacted_vehicles(
    vfm: DataFrame, changed_events: DataFrame, changed_cycles: DataFrame, params: Params, previous_as_of: int | None = None, masters: DataFrame | None = None,
) -> DataFrame:
    """Vehicles whose fault rows may differ at the new ``as_of``.

    Besides new messages and new engine cycles: an open episode may cross the
    cutoff without any new row, an episode may leave the analysed window, and
    ``masters`` (kind, key) names vehicles and codes whose master data changed.
    With ``previous_as_of`` only open episodes between the old and the new
    cutoff count as crossing.
    """
    crossing = F.col("is_resolved") == 0
    if previous_as_of is not None:
        crossing &= (F.col("last_ts") > previous_as_of - params.cutoff) & (F.col("last_ts") <= params.cutoff_ts)
    stale = vfm.filter(crossing | (F.col("first_ts") <= params.since_ts))
    found = [df.select(F.col("uniqueid").cast("string").alias("uniqueid")) for df in (changed_events, changed_cycles, stale)]
    if masters is not None:
        found.append(masters.filter("kind = 'vehicle'").select(F.col("key").alias("uniqueid")))
        codes = masters.filter("kind = 'code'").select(F.col("key").alias("dtc_code"))
        found.append(vfm.join(codes, "dtc_code", "left_semi").select("uniqueid"))
    return reduce(DataFrame.unionByName, found).distinct()


def rebuild_impacted(
    vfm: DataFrame, impacted: DataFrame, history: DataFrame, cycles: DataFrame, vehicles: DataFrame,
    codes: DataFrame, params: Params,
) -> DataFrame:
    """The fault master with the impacted vehicles recomputed and the others kept."""
    ids = stored(impacted.select("uniqueid").distinct())
    of = lambda df: df.join(ids, "uniqueid", "left_semi")
    vm = of(vehicles)
    fresh = vehicle_fault_master(events_exploded(of(history), vm, params), of(cycles), vm, codes, params)
    kept = vfm.join(ids, "uniqueid", "left_anti").select(*FAULT_COLUMNS)
    return kept.unionByName(fresh)


def run_incremental(
    spark, folder: str, history: DataFrame, cycles: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params,
    pipeline: str = "dtc", replay_hours: int = 1,
) -> DataFrame:
    """One run over the tables in ``folder``: the fault master brought to ``params.as_of``.

    The first run builds it whole. Later ones take the change window from the
    checkpoint, recompute the vehicles that it or a change of the master data
    touches, and overwrite only the months in which those have or had rows; a
    month that is left without rows goes. Digests of the master rows are kept
    beside the table for this; without them every vehicle is recomputed. Spark swaps the rewritten months after the last file is written,
    so a run that fails leaves the table as it was, up to whole months, and the checkpoint where it was.
    """
    path, layout = f"{folder}/vehicle_fault_master", writers.layouts()["vehicle_fault_master"]
    log, masters = f"{folder}/cdc_checkpoint", f"{folder}/master_digests"
    checkpoints = spark.read.parquet(log) if writers.exists(spark, log) else None
    window = cdc_window(checkpoints, pipeline, params.as_of, replay_hours, params.window_days)
    events = events_exploded(history, vehicles, params)
    # a table that lost all its rows has no file to take the schema from
    schema = fault_master_from_episodes(resolved_episodes(events, cycles, params), vehicles, codes, params).withColumn(
        layout.partition, layout.partition_expr).schema
    # stored: each run compares them and keeps them for the next one
    digests = stored(master_digests(vehicles, codes))
    if checkpoints is None:
        writers.write_partitioned(vehicle_fault_master(events, cycles, vehicles, codes, params), path, layout)
    else:
        old = spark.read.schema(schema).parquet(path)
        month = layout.partition
        changed = within(history, "ts", window.since_ts, window.until_ts)
        moved = cycles.filter((F.col("cycle_ts") > window.since_ts) & (F.col("cycle_ts") <= window.until_ts))
        staged = run_folder(spark)
        before = spark.read.parquet(masters) if writers.exists(spark, masters) else spark.createDataFrame([], "kind string, key string, digest long")
        touched_by = changed_masters(before, digests)
        impacted_vehicles(old, changed, moved, params, window.since_ts + replay_hours * 3600, touched_by).write.parquet(f"{staged}/ids")
        ids = spark.read.parquet(f"{staged}/ids")
        of = lambda df: df.join(ids, "uniqueid", "left_semi")
        vm = of(vehicles)
        fresh = vehicle_fault_master(events_exploded(of(history), vm, params), of(cycles), vm, codes, params)
        fresh = stored(fresh)
        months = lambda df: {r[0] for r in df.distinct().collect()}  # noqa: E731  a few per window
        new = months(fresh.select(layout.partition_expr.alias(month)))
        touched = months(of(old).select(month)) | new
        kept = old.filter(F.col(month).isin(*touched)).join(ids, "uniqueid", "left_anti")
        gone = touched - new
        gone -= months(kept.filter(F.col(month).isin(*gone)).select(month)) if gone else set()
        note_changes(spark, folder, old, ids)
        if touched - gone:
            # Spark puts the new files beside the table and swaps whole months after the last of them, so the old rows can be read meanwhile
            writers.rebuild(kept.select(*FAULT_COLUMNS).unionByName(fresh), path, layout, only_touched_partitions=True)
        for value in gone:
            writers.drop_partition(spark, path, month, value)
    # after the rows: a run that fails before this sees the change again
    digests.write.mode("overwrite").parquet(masters)
    table = spark.read.schema(schema).parquet(path)
    record_run(spark, folder, pipeline, window, table.count())
    return table


def run_rollups(
    spark, folder: str, history: DataFrame, cycles: DataFrame, vehicles: DataFrame, codes: DataFrame, params: Params,
    buckets: int = 64, **options,
) -> dict[str, DataFrame]:
    """One incremental run of the fault master and of the roll-ups above it, by name."""
    vfm = run_incremental(spark, folder, history, cycles, vehicles, codes, params, **options)
    return keep_rollups(spark, folder, vfm, vehicles, codes, params, buckets)


def sync_cutoff(state: DataFrame | None, pipeline_key: str, now, lookback_days: int = 14, safety_minutes: int = 5):
    """Start of the sync: last synced time minus the safety overlap, else the lookback."""
    from datetime import timedelta

    last = None
    if state is not None:
        last = state.filter(F.col("pipeline_key") == pipeline_key).agg(
            F.max_by("last_synced_at", "updated_at")).first()[0]
    if last is not None:
        return last - timedelta(minutes=max(int(safety_minutes), 0))
    return now - timedelta(days=max(int(lookback_days), 1))


def _with_state(runs: DataFrame, existing: DataFrame, cutoff) -> DataFrame:
    """Every run, marked eligible (``_ok``), empty (nothing to store) or known."""
    start = F.col("start_time")
    eligible = (start.isNull() | (start >= F.lit(cutoff))) & (F.coalesce("id", F.lit("")) != "")
    keyed = runs.withColumns({
        "_rid": _filled(F.col("extra.metadata.request_id"), F.col("id")), "_ok": eligible,
        "_empty": F.col("outputs").isNull() if "outputs" in runs.columns else F.lit(False)})
    known = existing.select(F.col("request_id").alias("_known")).distinct()
    return keyed.join(known, F.col("_rid") == F.col("_known"), "left")


_NEW = "_ok AND NOT _empty AND _known IS NULL"


def _batch(marked: DataFrame, batch: int | None) -> tuple[DataFrame, DataFrame]:
    """New runs of one sync, and all runs its watermark may pass.

    With a batch size the oldest new runs are taken, and the watermark stays
    behind the first one that is left for the next sync.
    """
    new = marked.filter(_NEW)
    if batch is None:
        return new, marked.filter("_ok")
    order = [F.col("start_time").asc_nulls_first(), F.col("id")]
    taken = new.orderBy(*order).limit(int(batch))
    last = taken.select(F.max(F.struct("start_time", "id"))).scalar()
    all_taken = taken.select(F.count("*")).scalar() < int(batch)
    passed = marked.filter("_ok").filter(
        F.coalesce(all_taken, F.lit(True)) | F.col("start_time").isNull() | (F.struct("start_time", "id") <= last))
    return taken, passed


def runs_to_insert(runs: DataFrame, existing: DataFrame, cutoff, batch: int | None = None) -> DataFrame:
    """Runs since the cutoff that are not stored; the oldest ``batch`` of them if that is given."""
    return _batch(_with_state(runs, existing, cutoff), batch)[0].select(*runs.columns)


def sync_report(runs: DataFrame, existing: DataFrame, cutoff, batch: int | None = None, failed: int = 0) -> DataFrame:
    """Counts of one sync and its new watermark: the latest start that no run left for later lies before."""
    marked = _with_state(runs, existing, cutoff)
    taken, passed = _batch(marked, batch)
    count = lambda cond: F.count(F.when(F.expr(cond), 1))
    all_ = marked.agg(
        F.count("*").alias("fetched"), count("_ok").alias("eligible"), count("_ok AND _empty").alias("skipped_empty"),
        count("_ok AND NOT _empty AND _known IS NOT NULL").alias("skipped_existing"))
    return all_.select(
        "*", (taken.select(F.count("*")).scalar() - F.lit(int(failed))).alias("inserted"), F.lit(int(failed)).cast("long").alias("failed"),
        passed.select(F.max("start_time")).scalar().alias("watermark"))


def sync_state(report: DataFrame, pipeline_key: str, now) -> DataFrame:
    """The state row to append after a sync; none when no eligible run had a start time."""
    note = F.concat(
        F.lit("inserted="), F.col("inserted").cast("string"),
        F.lit(", skipped_existing="), F.col("skipped_existing").cast("string"),
        F.lit(", failed="), F.col("failed").cast("string"))
    return report.filter("watermark IS NOT NULL").select(
        F.lit(pipeline_key).alias("pipeline_key"), F.col("watermark").alias("last_synced_at"),
        F.lit(now).alias("updated_at"), note.alias("note"))


def sync_runs(
    runs: DataFrame, existing: DataFrame, state: DataFrame | None, pipeline_key: str, now, *,
    lookback_days: int = 14, safety_minutes: int = 5, batch: int | None = None, store=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs to insert, the counts, and the state row of one sync.

    ``store`` writes the runs. If it raises, the sync counts them as failed,
    says why in a column ``error`` of the report and leaves no state row, so the next one
    takes them again. A repeated sync inserts nothing twice, as runs already
    stored are left out.
    """
    cutoff = sync_cutoff(state, pipeline_key, now, lookback_days, safety_minutes)
    new, failed, error = runs_to_insert(runs, existing, cutoff, batch), 0, None
    if store is not None:
        how_many = new.count()
        try:
            store(new)
        except Exception as e:
            failed, error = how_many, f"{type(e).__name__}: {e}"
    report = sync_report(runs, existing, cutoff, batch, failed)
    if error:
        report = report.withColumn("error", F.lit(error))
    fresh = sync_state(report, pipeline_key, now)
    return new, report, fresh.limit(0) if error else fresh
