"""Similarity join on Jaccard over word n-grams, with rare-first prefixes.

The n-grams of a text are put in one global order, rare ones first. Two sets
above the threshold share an n-gram within a short prefix of both, so only
prefixes are joined. A joined pair passes a length filter, a positional filter
(what can still follow the shared n-gram) and a suffix filter (what the parts
behind the prefixes can share at most) before its texts are compared in full,
once.

Copies are one set. Of a group of near copies not all pairs are made: in a
first round every member of an n-gram's list meets one member, the one with
the fewest rarer n-grams and so the fewest changes of its own; then only
members of different components meet, so a list that has grown together is
done. No pair of different components is left out.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, stored, text_or_empty
from faultloom.llm.components import star_components
from faultloom.llm.exact import lowered

#: Words of an n-gram, and the threshold in percent.
WIDTH, PERCENT = 3, 90
#: Counters of the n-gram frequencies. A shared counter only makes the order less sharp.
COUNTERS = 1 << 20
#: Parts of the suffix filter.
PARTS = 32
#: Words a worker remembers, and words of one text hashed at a time.
REMEMBERED, WORDS_AT_ONCE = 500_000, 1 << 18
#: Sets of n-grams a task keeps at hand when it compares pairs.
AT_HAND = 64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def gram_hashes(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams of a normalised text, sorted."""
    words = text.split(b" ") if text else []
    if not words:
        return np.zeros(0, np.uint64)
    k, parts = min(width, len(words)), []
    get = _WORDS.__getitem__
    for at in range(0, len(words) - k + 1, WORDS_AT_ONCE):
        part = words[at: at + WORDS_AT_ONCE + k - 1]
        h = np.fromiter(map(get, part), np.uint64, len(part))
        x = np.full(len(part) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ h[i: len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        parts.append(np.unique(x * np.uint64(0xBF58476D1CE4E5B9)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def grams(text: bytes, width: int) -> set[bytes]:
    """The n-grams themselves."""
    words = text.split(b" ") if text else []
    k = min(width, len(words))
    return {b" ".join(words[i: i + k]) for i in range(len(words) - k + 1)} if words else set()


def _normalise(fields: list[str]):
    """Words joined by single blanks, and their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = bytes_of(lowered(b.column(0)))
            view = memoryview(raw)
            texts = [b" ".join(bytes(view[s:e]).split()) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([bool(t) for t in texts]), b.column(1)], fields)

    return run


def _count(width: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(counters, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(found, (gram_hashes(t, width) % np.uint64(counters)).astype(np.int64), 1)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["counter", "n"])

    return run


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which any similar set has one within its own such prefix."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _prefixes(shared, width: int, percent: int, parts: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            sizes, heads, ends, rests = [], [], [], []
            for t in b.column(1).to_pylist():
                h = gram_hashes(t, width)
                # rare ones first, equally rare ones by their hash
                n = often[(h % np.uint64(len(often))).astype(np.int64)]
                order = np.argsort(n, kind="stable")
                h, p = h[order], prefix_length(len(h), percent)
                sizes.append(len(h))
                heads.append(h[:p].view(np.int64))
                # how far the prefix reaches in the global order, cut to a whole number
                ends.append(int(n[order[p - 1]]) << 32 | int(h[p - 1]) >> 32)
                rests.append(np.bincount((h[p:] >> np.uint64(32)).astype(np.int64) % parts, minlength=parts).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(ends, pa.int64()), pa.array(rests, pa.binary())], fields)

    return run


def least_overlap(n: Column, percent: int) -> Column:
    """Shared n-grams from which two sets of together ``n`` are similar."""
    return F.ceil(percent * n / (100 + percent)).cast("long")


def _may_share(parts: int):
    """The suffix filter: of two sets in one global order at most the longer prefix, and part by part the smaller count, can be shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, o = (np.frombuffer(bytes_of(b.column(i))[0].tobytes(), "<u4").reshape(-1, parts) for i in (2, 3))
            most = np.minimum(a, o).sum(axis=1).astype(np.int64) + b.column(4).to_numpy()
            yield b.filter(pa.array(most >= b.column(5).to_numpy())).select([0, 1])

    return run


def _similar(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand: OrderedDict[int, set[bytes]] = OrderedDict()

        def known(i: int, text: pa.Scalar) -> set[bytes]:
            if i in at_hand:
                at_hand.move_to_end(i)
            else:
                at_hand[i] = grams(text.as_py(), width)
                if len(at_hand) > AT_HAND:
                    at_hand.popitem(last=False)
            return at_hand[i]

        for b in batches:
            ok = []
            for i, (u, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                x, y = known(u, b.column(2)[i]), known(v, b.column(3)[i])
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """The pairs (u, v), each once, that are similar. Stored."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.size("head").cast("long").alias(f"p_{x}"), F.col("rest").alias(f"rest_{x}"))
    known = pairs.join(of("u"), "u").join(of("v"), "v")
    kept = known.select("u", "v", "rest_u", "rest_v", F.greatest("p_u", "p_v").alias("p"), least_overlap(F.col("n_u") + F.col("n_v"), percent).alias("least"))
    kept = stored(kept.mapInArrow(_may_share(parts), "u long, v long"))
    text = lambda x: texts.select(F.col("id").alias(x), F.col("norm").alias(f"norm_{x}"))
    whole = kept.join(text("u"), "u").join(text("v"), "v").select("u", "v", "norm_u", "norm_v")
    return stored(whole.mapInArrow(_similar(width, percent), "u long, v long"))


def _close(a: str, b: str, percent: int) -> Column:
    """Length filter, and positional filter of one shared n-gram at places ``at`` of both, with ``before`` n-grams in front that they may share."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    short, long_ = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    most = F.least(x("before"), y("before")) + F.least(x("n") - x("at"), y("n") - y("at"))
    return (100 * short >= percent * long_) & (most >= least_overlap(x("n") + y("n"), percent))


def _reach(a: str, b: str, percent: int) -> Column:
    """Of the set whose prefix ends first, the prefix shares what is in lists, the rest anything."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    least = least_overlap(x("n") + y("n"), percent)
    most = lambda s: s("listed") + F.ceil(percent * s("n") / 100).cast("long") - 1
    return F.when(x("end") < y("end"), most(x) >= least).when(y("end") < x("end"), most(y) >= least).otherwise(True)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.id", f"{b}.id").alias("u"), F.greatest(f"{a}.id", f"{b}.id").alias("v")]


def _first_round(entries: DataFrame, percent: int) -> DataFrame:
    """Every member of a list with the one that has the list's n-gram earliest; each pair once."""
    entries = entries.withColumn("before", F.col("at"))
    earliest = F.min_by(F.struct("id", "n", "at", "before"), F.struct("at", F.xxhash64("id", "gram")))
    heads = stored(entries.groupBy("gram").agg(earliest.alias("h"), F.count("*").alias("size")).filter("size > 1").select("gram", "h.*"))
    a, h = entries.alias("a"), heads.hint("merge").alias("h")
    return a.join(h, F.col("a.gram") == F.col("h.gram")).filter(F.col("a.id") != F.col("h.id")).filter(_close("a", "h", percent)).select(*_pair("a", "h")).distinct()


def _other_components(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list whose members are in different components; each pair once.

    Members outside a list's largest component meet all others, which leaves
    out no such pair and makes none inside the largest one.
    """
    placed = stored(entries.join(roots.hint("merge"), entries.id == roots.u, "left").select("gram", "id", "n", "end", "at", F.coalesce("root", "id").alias("root")))
    sizes = placed.groupBy("gram", "root").agg(F.count("*").alias("size"))
    mixed = stored(sizes.groupBy("gram").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("gram", "main"))
    # what two members of different components share before an n-gram of both prefixes is in mixed lists too
    of_set = Window.partitionBy("id")
    open_ = stored(placed.join(mixed.hint("merge"), "gram").withColumns({
        "before": F.row_number().over(of_set.orderBy("at")) - 1, "listed": F.count("*").over(of_set)}))
    a, b = open_.filter("root <> main").alias("a"), open_.hint("merge").alias("b")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.root") != F.col("b.root")) & once & _close("a", "b", percent) & _reach("a", "b", percent))
    # the shared n-grams of both prefixes are all there: behind the last of them no more than the shorter rest can follow
    first = F.col("a.id") < F.col("b.id")
    side = lambda c, x: F.when(first if x == "u" else ~first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"{c}_{x}")
    found = met.select(*_pair("a", "b"), *[side(c, x) for c in ("n", "at") for x in "uv"]).groupBy("u", "v", "n_u", "n_v").agg(
        F.count("*").alias("shared"), F.max("at_u").alias("last_u"), F.max("at_v").alias("last_v"))
    most = F.col("shared") + F.least(F.col("n_u") - F.col("last_u"), F.col("n_v") - F.col("last_v")) - 1
    return found.filter(most >= least_overlap(F.col("n_u") + F.col("n_v"), percent)).select("u", "v")


def similar_groups(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, counters: int = COUNTERS, parts: int = PARTS,
) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id.

    A-Z count as a-z; words are separated by the bytes 0x09-0x0D and 0x20. A
    row's set holds its distinct n-grams of ``width`` words; a text of fewer
    words is one n-gram. Null and texts without a word have the empty set,
    which is linked with nothing, not even its like. Rows link when their
    Jaccard similarity is ``percent`` or more. component_id is the smallest key
    reachable over links, that of the row itself included; rows without a key
    link too, and a component without any key has a null component_id. Rows
    that repeat, or that have the same words, are in one component. An empty
    table gives no rows. Other columns are neither read nor renamed.

    Sets are compared on the n-grams themselves; candidates come from 64-bit
    hashes, and n_shingles counts these.
    """
    kind = df.schema[key].dataType
    shape = T.StructType([T.StructField("norm", T.BinaryType()), T.StructField("sha", T.BinaryType()), T.StructField("some", T.BooleanType()), T.StructField("k", kind)])
    cols = df.select(text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k"))
    rows = stored(cols.mapInArrow(_normalise(shape.names), shape).withColumn("rid", F.monotonically_increasing_id()))
    # one set per sequence of words
    classes = stored(rows.filter("some").groupBy("sha").agg(F.min("rid").alias("id"), F.min("k").alias("k")))
    texts = stored(rows.join(classes.select(F.col("id").alias("rid")).hint("merge"), "rid", "left_semi").select(F.col("rid").alias("id"), "norm"))
    found = texts.select("norm").mapInArrow(_count(width, counters), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    # as Arrow: the counters are many for rows of the driver
    often = np.zeros(counters, np.int64)
    often[found["counter"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 31) - 1)
    shared = df.sparkSession.sparkContext.broadcast(often)
    shape = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("head", T.ArrayType(T.LongType())), T.StructField("end", T.LongType()), T.StructField("rest", T.BinaryType())])
    sets = stored(texts.mapInArrow(_prefixes(shared, width, percent, parts, shape.names), shape))
    entries = sets.select("id", "n", "end", F.posexplode("head").alias("at", "gram"))
    links = _verified(_first_round(entries, percent), sets, texts, width, percent, parts)
    roots = star_components(links)
    more = _verified(_other_components(entries, roots, percent), sets, texts, width, percent, parts)
    roots = star_components(links.union(more))
    placed = classes.join(sets.select("id", "n"), "id").join(roots.withColumnRenamed("u", "id"), "id", "left").select("sha", "k", "n", F.coalesce("root", "id").alias("root"))
    least = stored(placed.groupBy("root").agg(F.min("k").alias("component_id")))
    of_sha = stored(placed.join(least, "root").select("sha", "n", "component_id"))
    out = rows.select("k", "sha", "some").join(of_sha.hint("merge"), "sha", "left")
    return out.select(
        F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("some"), F.col("component_id")).otherwise(F.col("k")).alias("component_id"))
