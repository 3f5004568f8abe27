"""Raw messages to one row per vehicle, code and message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.params import Params
from faultloom.sources.readers import epoch_seconds, within

NULL_CODE = "0"  # fixed value: "no fault"


def analytics_window(history: DataFrame, params: Params) -> DataFrame:
    return within(history, "ts", params.since_ts, params.as_of)


def explode_codes(history: DataFrame) -> DataFrame:
    """One row per code of the message's code array."""
    return history.withColumn("dtc_code", F.explode("dtc_code"))


def drop_null_code(events: DataFrame) -> DataFrame:
    return events.filter(F.col("dtc_code") != NULL_CODE)


def events_exploded(history: DataFrame, vehicles: DataFrame, params: Params | None = None) -> DataFrame:
    """Events of known vehicles with tenant and number.

    The vehicle join comes before the explode, so that messages and not their
    codes pass the join. Whether the vehicle side is broadcast is left to
    Catalyst, which knows its size; a hot vehicle in the shuffled form is split
    by the adaptive skew join.
    """
    if params is not None:
        history = analytics_window(history, params)
    vm = vehicles.select("clientLoginId", "uniqueid", "vehicle_number")
    messages = history.select(
        F.col("uniqueid").cast("string").alias("uniqueid"),
        epoch_seconds(history, "ts").alias("ts"),
        "dtc_code",
        F.coalesce(F.col("lat").cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("lng").cast("double"), F.lit(0.0)).alias("lng"),
        F.coalesce(F.col("dtc_pgn").cast("string"), F.lit("")).alias("dtc_pgn"),
    )
    events = drop_null_code(explode_codes(messages.join(vm, "uniqueid")))
    return events.select("clientLoginId", "uniqueid", "vehicle_number", "ts", "dtc_code", "lat", "lng", "dtc_pgn")
