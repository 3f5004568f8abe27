"""Run records as lines of JSON text.

A line is parsed once, as VARIANT, and read into the record type field by field:
a field of another type than expected becomes null and is named in ``drift``, the
others are read all the same. Fields that the type does not know are named in
``unknown`` and stay readable in ``raw``. A line that is no record at all is set
aside with the reason. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom import schemas
from faultloom.sources import writers
from faultloom.sources.writers import Layout

# sections of a record whose own fields are looked over for unknown ones
SECTIONS = ("outputs", "extra.metadata")


def _scalars(dtype: T.StructType, at: str = "") -> Iterator[tuple[str, T.DataType]]:
    """(path, type) of every field outside arrays and maps."""
    for f in dtype.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _scalars(f.dataType, f"{at}{f.name}.")
        else:
            yield f"{at}{f.name}", f.dataType


def _section(dtype: T.StructType, path: str) -> T.StructType:
    for name in path.split("."):
        dtype = dtype[name].dataType
    return dtype


def _unread(record: Column, path: str, dtype: T.DataType) -> Column:
    """The path, if the record has a value there that the type cannot hold."""
    there = F.try_variant_get(record, f"$.{path}", "variant")
    value = F.try_variant_get(record, f"$.{path}", dtype.simpleString())
    return F.when(there.isNotNull() & ~F.is_variant_null(there) & value.isNull(), F.lit(path))


def _unknown(text: Column, dtype: T.StructType, at: str = "") -> Column:
    prefix = f"{at}." if at else ""
    names = F.json_object_keys(F.get_json_object(text, f"$.{at}") if at else text)
    known = F.array(*[F.lit(n) for n in dtype.fieldNames()])
    return F.coalesce(F.transform(F.array_except(names, known), lambda n: F.concat(F.lit(prefix), n)), F.array().cast("array<string>"))


def parse_run_lines(lines: DataFrame, schema: T.StructType = schemas.TRACE_RUN) -> DataFrame:
    """One row per line of ``value`` that is not blank; null lines are blank.

    ``reason`` is null for a record, else ``not json`` (cut off, garbled, a key
    twice in one object), ``not an object`` or ``no id`` (neither the record's nor
    a request's). Records have ``run`` (the typed record), ``raw``, ``drift`` and
    ``unknown``; the others keep their text in ``line``. Equal lines are equal
    rows; other columns of ``lines`` are not taken along.
    """
    parsed = lines.filter(F.trim("value") != "").select("value", F.try_parse_json("value").alias("raw"))
    raw = F.col("raw")
    named = F.coalesce(*[F.nullif(F.try_variant_get(raw, p, "string"), F.lit("")) for p in ("$.extra.metadata.request_id", "$.id")])
    reason = (F.when(raw.isNull(), "not json").when(~F.schema_of_variant(raw).startswith("OBJECT"), "not an object")
              .when(named.isNull(), "no id"))
    good = F.col("reason").isNull()
    drift = F.array_compact(F.array(*[_unread(raw, p, t) for p, t in _scalars(schema)]))
    unknown = F.concat(_unknown(F.col("value"), schema), *[_unknown(F.col("value"), _section(schema, s), s) for s in SECTIONS])
    return parsed.withColumn("reason", reason).select(
        "reason", F.when(~good, F.col("value")).alias("line"), F.when(good, raw).alias("raw"),
        F.when(good, F.try_variant_get(raw, "$", schema.simpleString())).alias("run"),
        F.when(good, drift).alias("drift"), F.when(good, unknown).alias("unknown"))


def append_run_lines(spark: SparkSession, source: str, path: str) -> None:
    """Parse text files and add them to the stored lines at ``path``, records and others in partitions of their own."""
    writers.append(parse_run_lines(spark.read.text(source)), path, Layout("ok", F.col("reason").isNull().cast("int")))


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """The records: the fields of the record type, ``raw``, ``drift`` and ``unknown``."""
    return spark.read.parquet(path).filter("ok = 1").select("run.*", "raw", "drift", "unknown")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The lines set aside, with their reason."""
    return spark.read.parquet(path).filter("ok = 0").select("line", "reason")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines per reason; ``ok`` stands for records, so all counts add up to the lines that are not blank."""
    return spark.read.parquet(path).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("lines"))
