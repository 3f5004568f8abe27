"""Helpers the text operators share: tables, stored intermediate results, Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.session import run_folder

#: The bytes 0x09-0x0D and 0x20, the only ones that separate words.
SPACES = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to a fresh folder all executors share and read again.

    This cuts the lineage: a lost executor costs a re-read, and every reader
    sees the same rows. Who owns ``spark.checkpoint.dir`` removes the folder.
    """
    path = f"{run_folder(df.sparkSession)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its len+1 offsets into them."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def filled(arr: pa.Array, value: str | bytes = "") -> pa.Array:
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    return pc.fill_null(arr, value) if arr.null_count else arr


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none clashes with an added one."""
    return F.struct(*columns(df, df.columns))
