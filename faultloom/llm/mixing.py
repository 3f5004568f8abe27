"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy number of each of its documents;
the whole part is taken outright, the fraction is rounded. Rounding pairs two
documents of a source and moves words from one to the other, at odds that keep
both expectations, until one fraction is 0 or 1; the other goes on to the next
pair. So words move but are not lost: a source ends within one document of its
target. Pairs are formed inside buckets of rows; what each bucket leaves open,
one document a source, meets in a reduction tree over the buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.functions.numbering import number_globally, number_within
from faultloom.llm.common import SPACES, bytes_of, filled, stored

WEIGHTS = (5, 2, 1)
#: Largest number of copies of a document, and of its source's size in the mix.
MOST = 3
#: Rows of a bucket, on average, and buckets that meet in one node of the tree.
BUCKET_ROWS, FAN_IN = 4096, 64
BYTES_AT_ONCE = 4 << 20
#: Fractions this close to 0 or 1 count as whole.
WHOLE = 1e-9

_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False


def word_counts(arr: pa.Array) -> np.ndarray:
    """Words of each text, separated by the bytes 0x09-0x0D and 0x20; null has none."""
    raw, offs = bytes_of(filled(arr))
    out = np.zeros(len(arr), np.int64)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BYTES_AT_ONCE, "right")) - 1)
        inside = _IN_WORD[raw[offs[at]: offs[to]]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = (offs[at: to] - offs[at])[np.diff(offs[at: to + 1]) > 0]
        first[starts] = inside[starts]
        out[at:to] = np.diff(np.searchsorted(np.flatnonzero(first), offs[at: to + 1] - offs[at]))
        at = to
    return out


def _sizes(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_counts(b.column(0))), *b.columns[1:]], fields)

    return run


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target of every source of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size, and the excess
    is shared by weight until none is above. Sources are numbered and summed by
    Spark; only sums reach the driver, once a round of sharing.
    """
    sums = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranks = number_globally(sums.filter("source IS NOT NULL").select("source"), "source", "rank")
    named = sums.filter("source IS NOT NULL").join(ranks, "source")
    unnamed = sums.filter("source IS NULL").withColumn("rank", F.lit(ranks.count() + 1))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = stored(named.unionByName(unnamed).select("source", "source_size", turn.alias("weight")))
    level = 0.0
    while True:
        # sources whose share at this level is above their limit stay at the limit; the level only rises
        full = F.lit(level) * F.col("weight") > most * F.col("source_size")
        total, held, weight = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        now = (total - held) / weight if weight else level
        if now <= level:
            break
        level = now
    return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.lit(float(most)) * F.col("source_size")).alias("target"))


class _Pivot:
    """Rounds the fractions of one group, one document after the other."""

    def __init__(self, seed: list[int]):
        self.random, self.open = np.random.default_rng(seed), None

    def add(self, row: int, size: int, part: float) -> list[tuple[int, int]]:
        """Takes a document in; gives (row, 0 or 1) of those that are settled."""
        if part <= WHOLE or part >= 1 - WHOLE:
            return [(row, round(part))]
        if not size:
            # no words to move: rounded on its own
            return [(row, int(self.random.random() < part))]
        if self.open is None:
            self.open = row, size, part
            return []
        other, s, p = self.open
        here, there = min(s * p, size * (1 - part)), min(size * part, s * (1 - p))
        move = here if self.random.random() * (here + there) < there else -there
        p, part = p - move / s, part + move / size
        self.open, done = None, []
        for r, n, x in ((other, s, p), (row, size, part)):
            if x <= WHOLE or x >= 1 - WHOLE:
                done.append((r, round(x)))
            else:
                self.open = r, n, x
        return done


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one node after the other, from a stream sorted by column ``node``."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        node = t.column("node").to_numpy()
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and s < e and held[0].column("node")[0].as_py() != node[s]:
                yield pa.concat_tables(held)
                held = []
            if s < e:
                held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def _round(seed: int, level: int, final: bool, fields: list[str]):
    """Settles all documents of each (node, source) but one; in the final round that one too.

    The number of rows of a node is bounded: a bucket, into which repeats come in pieces too, or FAN_IN rows a source.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _nodes(batches):
            sources, sizes, parts = t.column("source").to_pylist(), t.column("size").to_pylist(), t.column("part").to_numpy().copy()
            node = t.column("node")[0].as_py()
            up = np.full(len(sources), -1)
            by_source: dict[str | None, _Pivot] = {}
            for i, (source, size) in enumerate(zip(sources, sizes, strict=True)):
                if source not in by_source:
                    by_source[source] = _Pivot([seed, level, node, 1 << 32 if source is None else zlib.crc32(source.encode())])
                for r, x in by_source[source].add(i, size, float(parts[i])):
                    up[r] = x
            for pivot in by_source.values():
                if pivot.open:
                    i, _, part = pivot.open
                    parts[i] = part
                    if final:
                        up[i] = int(pivot.random.random() < part)
            t = t.drop_columns(["part"]).append_column("part", pa.array(parts)).append_column("up", pa.array(up, pa.int32(), mask=up < 0))
            yield from t.select(fields).combine_chunks().to_batches()

    return run


def _bucketed(sized: DataFrame, buckets: int, bucket_rows: int) -> DataFrame:
    """``sized`` with the bucket ``node`` instead of the place ``at``.

    A row's hash names its bucket; of rows that repeat more than ``bucket_rows``
    times each further ``bucket_rows`` go one bucket on. Which of them go where
    does not matter, as they are equal.
    """
    often = sized.groupBy("h").count().filter(F.col("count") > bucket_rows).select("h")
    piece = F.lit(0).cast("long")
    if not often.isEmpty():
        rows = sized.select("h", "at").join(often, "h", "left_semi")
        # numbers by the task that wrote the rows, so none sorts all repeats
        numbers = number_within(rows, ["h"], F.shiftright("at", 33), ["at"]).select(F.col("at").alias("place"), "rn")
        sized = sized.join(numbers, F.col("at") == F.col("place"), "left").drop("place")
        piece = F.coalesce(F.floor((F.col("rn") - 1) / bucket_rows), piece)
    return sized.withColumn("node", F.pmod(F.pmod("h", F.lit(buckets)) + piece, F.lit(buckets))).drop("at", "rn")


def mixed(
    df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS,
    most: int = MOST, seed: int = 17, row: bool = False, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``df``: key, size, source_size, target, copies, taken, and ``row`` (all columns) if asked for.

    size counts words (null: 0); taken is copies times size, and copies never
    exceeds ``most``. Rows without a source are a source of their own, the last
    one; rows without a key and repeated rows are rows like any other; rows
    without a word are rounded on their own. The same rows give the same
    result, however they are dealt out. An empty table gives no rows. Other
    columns are neither read nor renamed.
    """
    kind = df.schema[key].dataType
    body = F.col(f"`{text}`").cast("string")
    cols = [body.alias("t"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("k"),
            F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{source}`"), body).alias("h"),
            F.monotonically_increasing_id().alias("at")]
    shape = T.StructType([
        T.StructField("size", T.LongType()), T.StructField("source", T.StringType()), T.StructField("k", kind), T.StructField("h", T.LongType()), T.StructField("at", T.LongType())])
    if row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        shape.add("row", df.schema)
    sized = stored(df.select(*cols).mapInArrow(_sizes(shape.names), shape))
    buckets = -(-sized.count() // bucket_rows) or 1
    targets = source_targets(sized.select("source", "size"), weights, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(copies + WHOLE), F.lit(most))
    sized = _bucketed(sized, buckets, bucket_rows)
    sized = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        *[c for c in sized.columns if c != "node"], "source_size", "target", whole.alias("whole"),
        F.greatest(F.lit(0.0), F.when(whole < most, copies - whole).otherwise(0.0)).alias("part"),
        "node")
    shape = T.StructType([*sized.schema.fields, T.StructField("up", T.IntegerType())])
    order = ["node", "h", "k", "source", "size"]
    first = sized.repartition("node").sortWithinPartitions(*order).mapInArrow(_round(seed, 0, buckets == 1, shape.names), shape)
    # each source has one open document in a bucket at most, so bucket and source name it
    first = stored(first)
    left = first.filter("up IS NULL").select("source", F.col("node").alias("bucket"), "node", "size", "part")
    shape = T.StructType([*left.schema.fields, T.StructField("up", T.IntegerType())])
    settled, level = None, 0
    while buckets > 1:
        buckets, level = -(-buckets // fan_in), level + 1
        met = left.withColumn("node", F.floor(F.col("node") / fan_in)).repartition("node", "source").sortWithinPartitions("node", "source", "bucket")
        met = stored(met.mapInArrow(_round(seed, level, buckets == 1, shape.names), shape))
        done = met.filter("up IS NOT NULL").select("source", "bucket", F.col("up").alias("late"))
        settled = done if settled is None else settled.union(done)
        left = met.filter("up IS NULL").drop("up")
    if settled is not None:
        settled = settled.withColumnRenamed("source", "of")
        open_ = first.filter("up IS NULL").join(settled, F.col("source").eqNullSafe(F.col("of")) & (F.col("node") == F.col("bucket")), "left")
        first = first.filter("up IS NOT NULL").unionByName(open_.withColumn("up", F.col("late")).select(*first.columns))
    copies = (F.col("whole") + F.col("up")).cast("long")
    return first.select(
        F.col("k").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if row else []))


def take_copies(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    return mixed(df, text, key, source, row=True, **options).filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
