"""Exact duplicates by content sort.

Rows are range-partitioned on (leading bytes, digest, id) at splitters that
Spark samples, then sorted externally on the normalised bytes themselves, so
equal texts lie next to each other. Neighbours are compared in full. The id is
part of the range key: a text that a third of all rows share is spread over
many tasks, and the sort follows the same order. Only the first and last run
of a batch or partition can go on in another one; these, a row or two a batch,
meet in a grouping on the full text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultloom.llm.common import bytes_of, filled, stored, text_or_empty

#: Bytes of a text that take part in a splitter; the digest and the id follow them.
LEAD = 64


def lowered(arr: pa.Array) -> pa.Array:
    """A-Z in lower case, all other characters as they are; null is empty."""
    return pc.ascii_lower(filled(arr))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = lowered(b.column(0)).cast(pa.binary())
        raw, offs = bytes_of(norm)
        view = memoryview(raw)
        sha = pa.array([hashlib.sha256(view[s:e]).digest() for s, e in zip(offs[:-1], offs[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [norm, pc.binary_slice(norm, 0, LEAD), sha, *b.columns[1:]], ["norm", "lead", "sha", *b.schema.names[1:]])


class _Runs:
    """Numbers the runs of equal texts in a sorted stream of rows, and holds none of them.

    A run that may lie in more than one batch, or in more than one partition,
    goes out in fragments marked ``edge``; the first row of each has the text.
    """

    def __init__(self, pid: int, schema: pa.Schema):
        self.pid, self.schema, self.run, self.norm, self.head = pid, schema, -1, None, None

    def feed(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        norm, ids = b.column(0), b.column(2)
        new = np.ones(b.num_rows, bool)
        new[0] = self.norm is None or norm[0].as_py() != self.norm
        if b.num_rows > 1:
            new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        runs = self.run + np.cumsum(new)
        first = new.copy()
        first[0] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, b.num_rows))
        # the first run of a partition, one that goes on from the last batch, and the last one so far
        edge = (runs == runs[-1]) | (runs == 0) | (runs == self.run)
        texts = [norm[i].as_py() if f and e else None for i, (f, e) in enumerate(zip(first.tolist(), edge.tolist(), strict=True))]
        heads = ids.take(pa.array(np.repeat(starts, sizes)))
        if not new[0]:
            heads = pa.concat_arrays([pa.array([self.head] * int(sizes[0]), heads.type), heads.slice(int(sizes[0]))])
        out = [
            ids, pa.array(np.full(b.num_rows, self.pid, np.int32)), pa.array(runs), pa.array(np.repeat(sizes, sizes)), heads, pa.array(new),
            pa.array([x.hex() for x in b.column(1).to_pylist()], pa.string()), pa.array(edge), pa.array(texts, pa.binary()), *b.columns[3:]]
        self.run, self.norm, self.head = int(runs[-1]), norm[b.num_rows - 1].as_py(), heads[b.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays(out, schema=self.schema)


def _run_numbers(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = _Runs(TaskContext.get().partitionId(), schema)
        for b in batches:
            if b.num_rows:
                yield from runs.feed(b)

    return run


def exact_groups(
    df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", row: bool = False,
) -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256, and ``row`` (all columns) if asked for.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text, and equal empty texts are one group. ``keep`` says whether the
    smallest or the largest key of a group stays. Rows without a key take part
    and stay only if the group has no key. Of repeated rows (same text, same
    key) exactly one is kept. An empty table gives no rows. Other columns are
    neither read nor renamed, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    kind = df.schema[key].dataType
    cols = [text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k")]
    extra = [T.StructField("row", df.schema, True)] if row else []
    if row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    normal = T.StructType([
        T.StructField("norm", T.BinaryType()), T.StructField("lead", T.BinaryType()), T.StructField("sha", T.BinaryType()),
        T.StructField("k", kind), *extra])
    order = F.col("k").asc_nulls_last() if keep == "smallest" else F.col("k").desc_nulls_last()
    ranged = (
        df.select(*cols).mapInArrow(_normalise, normal)
        .repartitionByRange(F.col("lead"), F.col("sha"), order)
        .sortWithinPartitions("lead", "sha", "norm", order).drop("lead"))
    shape = T.StructType([
        T.StructField("k", kind), T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("head", kind), T.StructField("is_head", T.BooleanType()),
        T.StructField("sha", T.StringType()), T.StructField("edge", T.BooleanType()),
        T.StructField("edge_text", T.BinaryType()), *extra])
    numbered = stored(ranged.mapInArrow(_run_numbers(to_arrow_schema(shape)), shape))
    heads = numbered.filter(F.col("edge_text").isNotNull())
    # fragments of runs at the edges of partitions and batches, in full: a few a batch at most
    whole = heads.groupBy("edge_text").agg(
        F.sum("n").alias("all_n"), F.min_by("head", "pid").alias("all_head"), F.min("pid").alias("first_pid"),
        F.collect_set(F.struct("pid", "run")).alias("runs"))
    whole = whole.select("all_n", "all_head", "first_pid", F.explode("runs").alias("r")).select(
        F.col("r.pid").alias("pid"), F.col("r.run").alias("run"), "all_n", "all_head", "first_pid", F.lit(True).alias("edge"))
    joined = numbered.drop("edge_text").join(whole, ["pid", "run", "edge"], "left")
    return joined.select(
        F.col("k").alias(key), F.when(F.col("edge"), F.col("all_head")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("is_head") & (~F.col("edge") | (F.col("first_pid") == F.col("pid")))).alias("kept"),
        F.col("sha").alias("text_sha256"), *(["row"] if row else []))
