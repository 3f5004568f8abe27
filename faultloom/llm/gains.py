"""Importance resampling towards a target distribution, with n-grams interned in an open-addressed table.

Texts become runs of words joined by one blank, so every n-gram is a slice of
one buffer. A block's n-grams get xxhash64 keys, computed for all slices of a
length together, and are interned in an open-addressed NumPy table: equal keys
are verified byte by byte, each slot stores the bucket and the count of its
n-gram. Counting adds up slot counts per bucket; weighing gathers the gains of
the slots that the occurrences landed in.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, stored, text_or_empty
from faultloom.llm.exact import lowered

# fixed values: the terms of the draw
ORDER, BUCKETS, SCALE, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 1000, 20, 5, "42"

#: Bytes of text taken at a time (a longer text is taken alone), and words whose n-grams are interned together.
BYTES_AT_ONCE, BLOCK_WORDS = 4 << 20, 1 << 17
#: Longer n-grams are hashed and compared one by one.
LONG = 256

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# fixed values: the constants of xxhash64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _crc_tables() -> list[np.ndarray]:
    """Remainders of a byte that 0 to 7 zero bytes follow."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (x & np.uint32(1)) * np.uint32(0xEDB88320)
    out = [x]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ x[out[-1] & np.uint32(255)])
    return out


_CRC = _crc_tables()
_WIDE = [x.astype(np.uint64) for x in _CRC]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    return _turn(x * _P2, 31) * _P1


class Buffer:
    """Bytes with eight-byte reads at any place."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", self.bytes, strides=(1,)).copy()

    def slice(self, start: int, end: int) -> bytes:
        return self.bytes[start:end].tobytes()


def _by_length(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length and the places of the slices that have it; all those over LONG come together."""
    length = np.minimum(length, LONG + 1).astype(np.uint16)
    order = np.argsort(length, kind="stable")
    ends = np.cumsum(np.bincount(length))
    for n in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield n, order[ends[n - 1] if n else 0: ends[n]]


def _xxhash(buf: Buffer, at: np.ndarray, n: int) -> np.ndarray:
    """xxhash64 of the slices of ``n`` bytes that begin at ``at``."""
    done = 0
    if n >= 32:
        zero = np.zeros(len(at), np.uint64)
        lanes = [zero + x for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        while n - done >= 32:
            lanes = [_turn(v + buf.eight[at + (done + 8 * i)] * _P2, 31) * _P1 for i, v in enumerate(lanes)]
            done += 32
        h = sum((_turn(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True)), zero)
        for v in lanes:
            h = (h ^ _mixed(v)) * _P1 + _P4
    else:
        h = np.full(len(at), _P5)
    h = h + np.uint64(n)
    while n - done >= 8:
        h = _turn(h ^ _mixed(buf.eight[at + done]), 27) * _P1 + _P4
        done += 8
    if n - done >= 4:
        h = _turn(h ^ ((buf.eight[at + done] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        done += 4
    while done < n:
        h = _turn(h ^ (buf.bytes[at + done] * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def keys_of(buf: Buffer, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 of every slice."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for n, which in _by_length(length):
            if n <= LONG:
                out[which] = _xxhash(buf, start[which], n)
            else:
                out[which] = [xxhash.xxh64_intdigest(buf.slice(s, s + n)) for s, n in zip(start[which].tolist(), length[which].tolist(), strict=True)]
    return out


def _crc(buf: Buffer, at: np.ndarray, n: int) -> np.ndarray:
    """crc32 of the slices of ``n`` bytes that begin at ``at``, eight bytes a step.

    Zero bytes in front change nothing, so an incomplete step comes first. The
    usual start value turns the first four bytes round; a shorter slice goes
    byte by byte.
    """
    if n < 4:
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for i in range(n):
            crc = _CRC[0][(crc ^ buf.bytes[at + i]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        return ~crc
    crc, head = np.zeros(len(at), np.uint64), n % 8
    turned = 0xFFFFFFFF << (8 * (8 - head)) if head else 0xFFFFFFFF
    for place in range(head - 8 if head else 0, n, 8):
        if place < 0:
            x = buf.eight[at] << np.uint64(8 * (8 - head))
        else:
            x = buf.eight[at + place]
        x = x ^ crc ^ np.uint64(turned & 0xFFFFFFFFFFFFFFFF)
        turned >>= 64
        crc = _WIDE[7].take((x & np.uint64(255)).view(np.int64))
        for i in range(1, 8):
            crc ^= _WIDE[7 - i].take(((x >> np.uint64(8 * i)) & np.uint64(255)).view(np.int64))
    return ~crc


def crcs_of(buf: Buffer, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of every slice."""
    out = np.empty(len(start), np.uint32)
    for n, which in _by_length(length):
        if n <= LONG:
            out[which] = _crc(buf, start[which], n)
        else:
            out[which] = [zlib.crc32(buf.slice(s, s + n)) for s, n in zip(start[which].tolist(), length[which].tolist(), strict=True)]
    return out


def _equal(buf: Buffer, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices at ``a`` and ``b`` hold the same bytes; ``length`` is that of both."""
    same = np.ones(len(a), bool)
    open_, done = np.flatnonzero(length <= LONG), 0
    while len(open_):
        rest = length[open_] - done
        differ = buf.eight[a[open_] + done] ^ buf.eight[b[open_] + done]
        # little-endian: bytes behind the end are the upper ones
        differ = np.where(rest >= 8, differ, differ & ((np.uint64(1) << (8 * np.clip(rest, 0, 7)).astype(np.uint64)) - np.uint64(1)))
        same[open_[differ != 0]] = False
        open_, done = open_[(differ == 0) & (rest > 8)], done + 8
    for i in np.flatnonzero(length > LONG).tolist():
        same[i] = buf.slice(a[i], a[i] + length[i]) == buf.slice(b[i], b[i] + length[i])
    return same


class Interned:
    """The distinct slices of a block in an open-addressed table.

    ``slot`` holds each occurrence's place in the table, ``used`` the places in
    use; ``bucket`` and ``count`` are stored by place.
    """

    def __init__(self, buf: Buffer, start: np.ndarray, length: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        key = keys_of(buf, start, length) if keys is None else keys
        size = 1 << max(4, (2 * len(start)).bit_length())
        last = np.int64(size - 1)
        owner = np.full(size, -1, np.int32)
        self.slot = (key & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(start), dtype=np.int32)
        while len(todo):
            at = self.slot.take(todo)
            own = owner.take(at)
            free = own < 0
            # of several that claim a place one gets it; equal ones always come to the same place
            owner[at[free]] = todo[free]
            own = owner.take(at)
            same = own == todo
            maybe = np.flatnonzero(~same)
            o, t = own[maybe], todo[maybe]
            alike = (key.take(o) == key.take(t)) & (length.take(o) == length.take(t))
            maybe, o, t = maybe[alike], o[alike], t[alike]
            same[maybe] = _equal(buf, start[o], start[t], length[t])
            todo = todo[~same]
            self.slot[todo] = (self.slot[todo] + 1) & last
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        first = owner[self.used]
        self.bucket[self.used] = crcs_of(buf, start[first], length[first]) % np.uint32(buckets)


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by blanks, start and end of each, and the text each belongs to."""
    x = np.insert(raw, offs[1:-1], 0)
    of_word = _WORD[x]
    keep = of_word.copy()
    keep[1:] |= of_word[:-1]
    starts = np.flatnonzero(of_word & ~np.concatenate([[False], of_word[:-1]]))
    owner = np.searchsorted(offs[1:-1] + np.arange(len(offs) - 2), starts, "left") if len(offs) > 2 else np.zeros(len(starts), np.int64)
    line = np.where(of_word, x, np.uint8(32))[keep]
    blank = line == 32
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(line) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1 if len(line) else np.zeros(0, np.int64)
    return line, begin, end, owner


def _blocks(b: pa.RecordBatch, order: int, buckets: int) -> Iterator[tuple[np.ndarray, Interned | None, np.ndarray]]:
    """(words per text, table, text of each occurrence) for the texts of a batch, a block of words at a time.

    The first of the three has an entry for each text of the batch and counts the words of the block.
    """
    raw, offs = bytes_of(lowered(b.column(0)))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BYTES_AT_ONCE, "right")) - 1)
        line, begin, end, owner = _words(raw[offs[at]: offs[to]], offs[at: to + 1] - offs[at])
        for s in range(0, len(begin), BLOCK_WORDS):
            e = min(s + BLOCK_WORDS, len(begin))
            reach = min(e + order - 1, len(begin))
            lo = begin[s]
            start, length, text = [], [], []
            for n in range(order):
                # the word n places on, where it is a word of the same text
                k = np.arange(s, max(s, min(e, reach - n)))
                k = k[owner[k] == owner[k + n]]
                start.append(begin[k] - lo)
                length.append(end[k + n] - begin[k])
                text.append(owner[k] + at)
            table = Interned(Buffer(line[lo: end[reach - 1]]), np.concatenate(start), np.concatenate(length), buckets)
            yield np.bincount(owner[s:e] + at, minlength=b.num_rows), table, np.concatenate(text)
        at = to


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, table, _ in _blocks(b, order, buckets):
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket. A task gives a row for each bucket at most, and as many reach the driver."""
    rows = df.select(text_or_empty(text).alias("t")).mapInArrow(_count(order, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(all_: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Per bucket the scaled log of its smoothed share in the target over that in all text, rounded down."""
    s, t, k = float(all_.sum()), float(target.sum()), float(len(all_))
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(all_.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(key: object, seed: str, scale: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(shared, order: int, seed: str, scale: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            words, grams, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for n, table, text in _blocks(b, order, len(gain)):
                words += n
                grams += np.bincount(text, minlength=b.num_rows)
                # whole numbers far below 2**53: exact as doubles
                weight += np.bincount(text, gain[table.bucket][table.slot], b.num_rows).astype(np.int64)
            noise = np.array([_noise(k, seed, scale) for k in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(grams), pa.array(weight), pa.array(weight + noise), b.column(2)], fields)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid, at = TaskContext.get().partitionId(), 0
    for b in batches:
        place = [pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
        yield pa.RecordBatch.from_arrays([*b.columns, *place], [*b.schema.names, "pid", "at"])
        at += b.num_rows


def drawn(
    df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    order: int = ORDER, buckets: int = BUCKETS, seed: str = SEED, scale: int = SCALE,
) -> DataFrame:
    """One row per row of ``df``: key, n_features, weight, score, rank (null where the row is not drawn).

    Features are the runs of 1 to ``order`` words, repeats counted; null counts
    as the empty text, which has none and weight 0. Of the rows with
    ``least_words`` words the ``percent`` with the highest scores are drawn,
    rounded down, ties to the smaller key. Repeated rows are rows each; those
    without a key share one random number and come last in a tie. An empty
    table gives no rows; an empty target makes all gains fall with a bucket's
    count. Other columns are neither read nor renamed.
    """
    gain = gains(bucket_counts(df, text, order, buckets), bucket_counts(target, text, order, buckets), scale)
    shared = df.sparkSession.sparkContext.broadcast(gain)
    k = F.col(f"`{key}`")
    cols = df.select(text_or_empty(text).alias("t"), k.cast("string").alias("name"), k.alias("k"))
    shape = T.StructType([*(T.StructField(n, T.LongType()) for n in ("words", "grams", "weight", "score")), T.StructField("k", df.schema[key].dataType)])
    weighed = stored(cols.mapInArrow(_weigh(shared, order, seed, scale, shape.names), shape))
    # all rows in order of rank, those that take no part last: a number for each without a sort in one task
    rank = [(F.col("words") < least_words).asc(), F.desc("score"), F.col("k").asc_nulls_last()]
    placed = T.StructType([*weighed.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("at", T.LongType())])
    ranged = stored(weighed.repartitionByRange(*rank).sortWithinPartitions(*rank).mapInArrow(_numbered, placed))
    # a row per partition
    sizes = ranged.groupBy("pid").agg(F.count("*").alias("n"), F.count_if(F.col("words") >= least_words).alias("enough"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("enough").over(Window.partitionBy()).alias("enough"))
    number = F.col("before") + F.col("at") + 1
    return ranged.join(F.broadcast(offsets), "pid").select(
        F.col("k").alias(key), F.col("grams").alias("n_features"), "weight", "score",
        F.when(number <= F.floor(F.lit(percent) * F.col("enough") / 100), number).alias("rank"))
