"""Readers of raw messages, cycles, dimensions, questions and trace runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom import schemas

# fixed values: vehicles with these solution types carry an on-board-diagnostics device
OBD_SOLUTIONS = ("obd_solution", "obd_analog_solution", "obd_fuel+fuel_solution")


def _at(df: DataFrame, col: str, epoch: int) -> Column:
    """An epoch second as a literal of the column's own type, so that the
    comparison reaches the file scan as a plain range filter."""
    moment = datetime.fromtimestamp(epoch, tz=timezone.utc)
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(moment.replace(tzinfo=None))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_seconds(F.lit(epoch))
    return F.lit(epoch)


def epoch_seconds(df: DataFrame, col: str) -> Column:
    """Whole epoch seconds of a timestamp or numeric column."""
    if isinstance(df.schema[col].dataType, (T.TimestampNTZType, T.TimestampType)):
        return F.unix_timestamp(F.col(col))
    return F.floor(F.col(col)).cast("long")


def within(df: DataFrame, col: str, since_ts: int, until_ts: int) -> DataFrame:
    """Rows whose whole second lies in ``(since_ts, until_ts]``."""
    return df.filter((F.col(col) >= _at(df, col, since_ts + 1)) & (F.col(col) < _at(df, col, until_ts + 1)))


def read_dtc_history(spark: SparkSession, path: str, since_ts: int, until_ts: int) -> DataFrame:
    history = spark.read.parquet(path)
    return within(history.select(*schemas.DTC_HISTORY.fieldNames()), "ts", since_ts, until_ts)


def engine_cycle_seconds(cycles: DataFrame) -> DataFrame:
    """(uniqueid, cycle_ts) of the rows that have a cycle end."""
    return cycles.filter(F.col("cycle_end_ts").isNotNull()).select(
        F.col("uniqueid").cast("string").alias("uniqueid"),
        epoch_seconds(cycles, "cycle_end_ts").alias("cycle_ts"),
    )


def read_engine_cycles(spark: SparkSession, path: str) -> DataFrame:
    return engine_cycle_seconds(spark.read.parquet(path))


def _first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def resolve_vehicle_profile(df: DataFrame) -> DataFrame:
    """Vehicle rows from a source whose column names vary.

    The candidate names and their order are fixed values.
    """

    def text(*names: str) -> Column:
        found = _first_present(df.columns, names)
        return F.coalesce(F.col(found).cast("string"), F.lit("")) if found else F.lit("")

    def number(dtype: str, *names: str) -> Column:
        found = _first_present(df.columns, names)
        value = F.col(found).cast("string").try_cast(dtype) if found else F.lit(None).cast(dtype)
        return F.coalesce(value, F.lit(0).cast(dtype))

    uniqueid = _first_present(df.columns, ("uniqueid", "unique_id"))
    if uniqueid is None:
        raise ValueError("vehicle profile has no uniqueid column")
    return df.select(
        text("clientLoginId").alias("clientLoginId"),
        F.col(uniqueid).cast("string").alias("uniqueid"),
        text("vehicle_number", "registration_number", "vehicle_no").alias("vehicle_number"),
        text("customer_name", "customer", "customername").alias("customer_name"),
        text("model", "vehicle_model").alias("model"),
        number("int", "manufacturing_year", "mfg_year", "model_year").alias("manufacturing_year"),
        text("vehicle_type").alias("vehicle_type"),
        text("solutionType").alias("solutionType"),
        number("double", "tank_capacity", "fuel_tank_capacity", "tankcapacity").alias("tank_capacity"),
        *([F.col("updated_at")] if "updated_at" in df.columns else []),
    )


def latest_by_key(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """One row per key, the one with the greatest version.

    ``max_by`` combines on the map side, so a key with very many versions
    sends one row per task through the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(v) if isinstance(v, str) else v for v in version])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def build_vehicle_master(profile: DataFrame) -> DataFrame:
    """One row per tenant and vehicle: the newest, and of equals the greatest in column order."""
    vehicles = profile.filter(F.col("solutionType").isin(*OBD_SOLUTIONS))
    keys = ["clientLoginId", "uniqueid"]
    rest = [c for c in vehicles.columns if c not in keys]
    return latest_by_key(vehicles, keys, ["updated_at", *rest] if "updated_at" in rest else rest)


def build_dtc_master(codes: DataFrame) -> DataFrame:
    """Code dimension with every attribute present; absent ones take the table default."""
    cols = [F.col("dtc_code").cast("string").alias("dtc_code")]
    for name, default in schemas.DTC_MASTER_DEFAULTS.items():
        dtype = {int: "int", float: "double", str: "string"}[type(default)]
        value = F.col(name).cast(dtype) if name in codes.columns else F.lit(default).cast(dtype)
        cols.append(F.coalesce(value, F.lit(default).cast(dtype)).alias(name))
    if "updated_at" in codes.columns:
        return latest_by_key(codes.select(*cols, "updated_at"), ["dtc_code"], ["updated_at"])
    return codes.select(*cols)


def first_per_dataset(questions: DataFrame, per_dataset_limit: int = 0) -> DataFrame:
    """The first N questions of each dataset by position; 0 keeps all."""
    if per_dataset_limit <= 0:
        return questions
    w = Window.partitionBy("dataset").orderBy("position")
    return questions.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_dataset_limit).drop("_rn")


def read_eval_questions(spark: SparkSession, paths: Sequence[str], per_dataset_limit: int = 0) -> DataFrame:
    """Union of JSON-array question files, each file one dataset in file order."""
    raw = spark.read.schema(schemas.EVAL_QUESTION).json(list(paths), multiLine=True)
    meta = raw.select("*", F.col("_metadata.file_name").alias("dataset"))
    # a question file is one JSON document and hence one task: rising ids follow file order
    return first_per_dataset(meta.withColumn("position", F.monotonically_increasing_id()), per_dataset_limit)


def failed_ids(per_question: DataFrame) -> DataFrame:
    """Trimmed ids of report rows that list a failure reason."""
    return (
        per_question.filter(F.size(F.coalesce("failure_reasons", F.array().cast("array<string>"))) > 0)
        .select(F.trim("id").alias("id")).filter("id <> ''").distinct()
    )


def filter_questions(questions: DataFrame, ids: Sequence[str] = (), failed: DataFrame | None = None) -> DataFrame:
    """Questions named explicitly or failed before; with neither, all of them."""
    wanted = [i.strip() for i in ids if i.strip()]
    key = F.trim("id")
    if failed is None:
        return questions.filter(key.isin(*wanted)) if wanted else questions
    selected = failed.select(F.col("id").alias("_want"))
    if wanted:
        named = questions.filter(key.isin(*wanted)).select(key.alias("_want"))
        selected = selected.unionByName(named)
    # an empty selection means no filter at all
    how_many = selected.select(F.count("*")).scalar()
    return questions.join(selected.distinct(), key == F.col("_want"), "left").filter(
        F.col("_want").isNotNull() | (how_many == 0)).select(*questions.columns)


def _filled(*cols: Column) -> Column:
    """First non-empty text, or the empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


def read_trace_runs(runs: DataFrame, passed: Sequence[str] = ()) -> DataFrame:
    """Nested run records -> one row per run with the query and the payload
    fields; the ``passed`` columns of the record go along."""
    o, meta = "outputs", "extra.metadata"
    last_message = F.try_element_at(F.col(f"{o}.messages"), F.lit(-1)).getField("content")
    out = runs.select(
        _filled(F.col(f"{meta}.request_id"), F.col("id")).alias("request_id"),
        F.col("start_time").alias("ts"),
        _filled(F.col(f"{meta}.query"), F.col("inputs.query")).alias("query"),
        _filled(F.col(f"{o}.text"), last_message).alias("text"),
        _filled(F.col(f"{o}.intent"), F.col(f"{meta}.intent")).alias("intent"),
        F.col(f"{o}.trace_log").alias("trace_log"),
        F.col(f"{o}.evaluation").alias("evaluation"),
        F.col(f"{o}.nodes_executed").alias("nodes_executed"),
        F.col(f"{o}.version").alias("version"),
        F.col(f"{o}.tools_called").alias("tools_called"),
        F.col(f"{o}.sql_events").alias("sql_events"),
        F.col(f"{o}.token_usage").alias("token_usage"),
        F.col(f"{o}.failure_reasons").alias("failure_reasons"), *passed,
    )
    return out.filter("request_id <> ''")


def list_trace_runs(
    runs: DataFrame, limit: int | None = None, start_date=None, end_date=None, **equals: str | None,
) -> DataFrame:
    """Runs that pass all filters, newest first; the newest ``limit`` of them if that is given."""
    meta = "extra.metadata"
    rows = runs.filter("start_time IS NOT NULL AND id <> ''").select(
        _filled(F.col(f"{meta}.request_id"), F.col("id")).alias("request_id"),
        F.col("id").alias("run_id"),
        F.col("start_time").alias("ts"),
        _filled(F.col(f"{meta}.query"), F.col("inputs.query")).alias("query"),
        _filled(F.col(f"{meta}.intent")).alias("intent"),
        F.coalesce(F.col("outputs.evaluation.final_score"), F.lit(0.0)).alias("final_score"),
        F.coalesce(F.nullif(F.col("outputs.evaluation.root_cause"), F.lit("")), F.lit("unknown")).alias("root_cause"),
        _filled(F.col(f"{meta}.env_name")).alias("env_name"),
        _filled(F.col(f"{meta}.release_version")).alias("release_version"),
    )
    if start_date is not None:
        rows = rows.filter(F.to_date("ts") >= F.lit(start_date))
    if end_date is not None:
        rows = rows.filter(F.to_date("ts") <= F.lit(end_date))
    for name, value in equals.items():
        if value not in (None, "", "All"):
            rows = rows.filter(F.col(name) == value)
    rows = rows.orderBy(F.desc("ts"), "run_id")
    return rows if limit is None else rows.limit(int(limit))
