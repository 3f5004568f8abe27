"""Quality by importance resampling over hashed n-grams.

Two generative models over hashed words and word pairs: one of target text
(documents labelled good), one of all text. A document's weight is the log
ratio of its likelihood under both. Gumbel top-k on the weights draws a sample
of the raw text, without replacement, that is distributed like the target. The
k-th largest key is found digit by digit from counts, so no task sorts all keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, stored, text_or_empty
from faultloom.llm.exact import lowered

BUCKETS = 1 << 16
#: Added to each bucket's count in both models.
SMOOTHING = 1.0
#: Share of the rows drawn, and labelled good rows the target model is fitted on (whole texts, drawn by a hash of the key).
KEEP, TARGET_ROWS = 0.5, 20_000
SEED = 11
#: Words a worker remembers, and words hashed at a time.
REMEMBERED, WORDS_AT_ONCE = 500_000, 1 << 18
#: Bits of a key found in a round.
DIGIT = 11


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word, SEED)
        return value


_WORDS = _Words()


def features(text: bytes, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all words and pairs of neighbouring words of a lower-cased text, with repeats."""
    words = text.split()
    get = _WORDS.__getitem__
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at: at + WORDS_AT_ONCE + 1]
        h = np.fromiter(map(get, part), np.uint64, len(part))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        own = h[:WORDS_AT_ONCE]
        yield (np.concatenate([own, pairs]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    """Per task a row for each bucket seen: its count in all texts and in target texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            raw, offs = bytes_of(lowered(b.column(0)))
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data = raw.tobytes()
            for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                for f in features(data[s:e], buckets):
                    n = np.bincount(f, minlength=buckets) if len(f) > buckets // 8 else None
                    for k in (0, 1) if good[i] else (0,):
                        if n is None:
                            np.add.at(total[k], f, 1)
                        else:
                            total[k] += n
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "n_all", "n_good"])

    return run


def _weigh(shared, buckets: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            raw, offs = bytes_of(lowered(b.column(0)))
            data = raw.tobytes()
            weight, grams = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                for f in features(data[s:e], buckets):
                    weight[i] += ratio[f].sum()
                    grams[i] += len(f)
            key = weight + b.column(1).to_numpy(zero_copy_only=False) + 0.0
            bits = key.view(np.int64)
            # the same order as integers: negative numbers have their other bits turned round
            order = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(weight), pa.array(key), pa.array(order), *b.columns[2:]], fields)

    return run


def target_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TARGET_ROWS) -> DataFrame:
    """About ``rows`` keys that are labelled 1 at least once, all if there are fewer; nulls are left out."""
    good = labels.filter(F.col(f"`{label}`") == 1).select(F.col(f"`{key}`").alias("g")).filter("g IS NOT NULL").distinct()
    share = min(1.0, rows / max(1, good.count()))
    return good.filter(F.pmod(F.xxhash64(F.lit(SEED), "g"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def log_ratios(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket the log of its probability in target text over that in all text.

    All text of ``df`` is counted. ``target`` (column g) is a bounded set of
    keys, so it is broadcast and no text is shuffled. At most a row for each
    bucket reaches the driver.
    """
    texts = df.select(text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k"))
    marked = texts.join(F.broadcast(target), F.col("k") == F.col("g"), "left").select("t", F.col("g").isNotNull().alias("good"))
    rows = marked.mapInArrow(_count(buckets), "bucket long, n_all long, n_good long").groupBy("bucket").agg(F.sum("n_all").alias("a"), F.sum("n_good").alias("g")).toPandas()
    count = np.full((2, buckets), smoothing)
    count[0][rows["bucket"].to_numpy(np.int64)] += rows["a"].to_numpy(np.float64)
    count[1][rows["bucket"].to_numpy(np.int64)] += rows["g"].to_numpy(np.float64)
    p = np.log(count / count.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def kth_largest(keys: DataFrame, k: int, column: str = "order") -> int:
    """The k-th largest value of a bigint column of at least k rows: eleven bits a round, a count per digit to the driver."""
    high = keys.select((F.col(column).bitwiseXOR(F.lit(-(1 << 63)))).alias("x"))
    known, left = 0, 64
    while left:
        step = min(DIGIT, left)
        left -= step
        digit = F.shiftrightunsigned("x", left).bitwiseAND(F.lit((1 << step) - 1)) if left else F.col("x").bitwiseAND(F.lit((1 << step) - 1))
        here = high.filter(F.shiftrightunsigned("x", left + step) == F.lit(known)) if left + step < 64 else high
        counts = {r["d"]: r["count"] for r in here.groupBy(digit.alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= k:
                known = (known << step) | d
                break
            k -= counts[d]
    return known - (1 << 63)


def resampled(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: float = KEEP,
    rows: int = TARGET_ROWS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: key, grams, log_weight, gumbel_key, selected.

    A-Z count as a-z; null counts as the empty text, which has no grams and
    weight 0. The share ``keep`` of the rows with the largest keys is selected;
    rows that tie with the last of them are selected too, so repeated rows
    share their fate. Rows without a key share one random draw. Without a
    label of 1 all weights are near 0 and the draw is uniform. An empty table
    gives no rows. Other columns are neither read nor renamed.
    """
    ratio = log_ratios(df, target_keys(labels, key, label, rows), text, key, buckets)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cols = df.select(text_or_empty(text).alias("t"), (-F.log(-F.log(uniform))).alias("noise"), F.col(f"`{key}`").alias("k"))
    shape = T.StructType([
        T.StructField("grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType()),
        T.StructField("order", T.LongType()), T.StructField("k", df.schema[key].dataType)])
    shared = df.sparkSession.sparkContext.broadcast(ratio)
    weighed = stored(cols.mapInArrow(_weigh(shared, buckets, shape.names), shape))
    drawn = int(np.ceil(keep * weighed.count()))
    least = kth_largest(weighed, drawn) if drawn else (1 << 63) - 1
    return weighed.select(F.col("k").alias(key), "grams", "log_weight", "gumbel_key", (F.col("order") >= F.lit(least)).alias("selected"))
