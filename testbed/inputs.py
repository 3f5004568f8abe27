"""Engine inputs derived from the driver's tables, as FIXTURES.md describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom import Params
from faultloom.plans.pipeline import Warehouse

PARAMS = Params(as_of=1706659200, gap=86400, cutoff=259200, k=0.2)
DAYS = 14
CODE = "P0011"
CUSTOMER = "MACHINERY"

_warehouses: dict[tuple[str, str], Warehouse] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(number) -> F.Column:
    return F.format_string("P%04d", number)


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def history_from_events(events: DataFrame) -> DataFrame:
    k = F.col("k")
    first = F.when((F.col("event_type") == "view") & (k % 5 == 0), "0").otherwise(_code(k % 10))
    return _with_k(events.filter("event_type <> 'signup'")).select(
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("uniqueid"), "ts",
        F.array(first, _code(10 + k % 3)).alias("dtc_code"),
        F.when(k % 7 != 0, F.col("value")).alias("lat"), (-F.col("value")).alias("lng"),
        F.when(k % 4 != 0, k.cast("string")).alias("dtc_pgn"),
    )


def dtc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_events(table(spark, sf_dir, "events"))


def engine_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_k(table(spark, sf_dir, "events").filter("event_type = 'signup'")).select(
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("uniqueid"),
        F.when(F.col("k") % 11 != 0, F.col("ts")).alias("cycle_end_ts"))


def vehicle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), (nation % 5).cast("string")).alias("clientLoginId"),
        F.concat(F.lit("V"), key.cast("string")).alias("uniqueid"),
        F.col("c_name").alias("registration_number"),
        F.when(nation % 6 == 0, "").otherwise(F.col("c_mktsegment")).alias("customer"),
        F.concat(F.lit("M"), nation.cast("string")).alias("vehicle_model"),
        (2010 + key % 12).cast("string").alias("mfg_year"),
        F.col("c_mktsegment").alias("vehicle_type"),
        F.element_at(F.array(*[F.lit(s) for s in (
            "obd_solution", "obd_analog_solution", "obd_fuel+fuel_solution", "gps_only")]),
            (key % 4 + 1).cast("int")).alias("solutionType"),
    )


def dtc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "part").filter("p_partkey <> 12").select(
        _code(key).alias("dtc_code"),
        pick(("Engine", "Emission Control", "Safety", "Electrical", "nan", "None"), 6).alias("system"),
        pick(("Powertrain", "Coolant", "Emission", "Electrical", "None"), 5).alias("subsystem"),
        F.col("p_name").alias("description"), F.col("p_type").alias("primary_cause"),
        F.col("p_brand").alias("symptoms"), (F.col("p_size") % 5).alias("severity_level"),
        (F.col("p_retailprice") / 1000).alias("estimated_repair_hours"),
        (F.col("p_size") % 2).alias("driver_related"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Inspect "), F.col("p_name"))).alias("action_required"),
    )


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One warehouse per application and input folder, so that the queries of
    one run read tables that are built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _warehouses:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _warehouses[key] = Warehouse(
            spark, history=dtc_history(spark, sf_dir), cycles=engine_cycles(spark, sf_dir),
            profile=vehicle_profile(spark, sf_dir), codes=dtc_codes(spark, sf_dir), params=PARAMS)
    return _warehouses[key]
