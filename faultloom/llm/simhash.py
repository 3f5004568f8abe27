"""Near-duplicates by SimHash and a self-join of binary tries.

Each text gets a 64-bit fingerprint. Two fingerprints within 3 bits agree on
one of four 16-bit blocks at least, so each distinct fingerprint goes into
four tries, each with another block in front, and each trie is cut below that
block into subtries that tasks share out. A sorted array of rotated
fingerprints is the trie: a node is a range of rows. The self-join walks node
pairs together level by level, adds up differing bits and drops a pair once
the budget is exceeded, or once all its rows are known to be connected. A task
gives out a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import as_row, bytes_of, stored, text_or_empty
from faultloom.llm.components import star_components
from faultloom.llm.exact import lowered

SEED = 42
BUDGET = 3
#: Subtries with more fingerprints are cut again, eight levels deeper.
HOT_SUBTRIE = 262_144
#: Words of one text hashed at a time.
WORDS_AT_ONCE = 1 << 17
#: Rows a task walks at a time (whole subtries), node pairs expanded at a time, and pairs of rows tested directly.
WALK_ROWS, FRONTIER, DIRECT = 500_000, 1 << 16, 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Changes of eight bits that stay within the budget.
_NEAR = [d for d in range(256) if d.bit_count() <= BUDGET]


def _fingerprint(text: bytes, width: int) -> int:
    words = text.split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(8 * 256, np.int64), max(1, len(words) - width + 1)
    place = np.arange(8) * 256
    for at in range(0, n, WORDS_AT_ONCE):
        part = words[at: at + WORDS_AT_ONCE + width - 1]
        line = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        ends = np.cumsum(sizes)
        k = min(width, len(part))
        spans = zip((ends - sizes)[: len(part) - k + 1].tolist(), (ends[k - 1:] - 1).tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        counts += np.bincount((hashes + place).ravel(), minlength=2048)
    # digests are big-endian: byte 0 holds bits 63..56
    ones = (counts.reshape(8, 256) @ _BITS)[::-1].ravel()
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = bytes_of(lowered(b.column(0)))
            data = raw.tobytes()
            fps = np.fromiter((_fingerprint(data[s:e], width) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, len(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), *b.columns[1:]], ["fp", *b.schema.names[1:]])

    return run


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    while True:
        a, b = _roots(parent, u), _roots(parent, v)
        differ = a != b
        if not differ.any():
            break
        a, b, u, v = a[differ], b[differ], u[differ], v[differ]
        parent[np.maximum(a, b)] = np.minimum(a, b)
    parent[:] = _roots(parent, np.arange(len(parent)))


def _expand(lo_a, hi_a, lo_b, hi_b, same):
    """All row pairs of the node pairs; for a node with itself each pair once."""
    na, nb = hi_a - lo_a, hi_b - lo_b
    total = na * nb
    owner = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
    i, j = lo_a[owner] + k // nb[owner], lo_b[owner] + k % nb[owner]
    once = ~same[owner] | (i < j)
    return i[once], j[once]


def walk(rot: np.ndarray, node: np.ndarray, parent: np.ndarray, pairs: list[np.ndarray], depth: int) -> None:
    """Walk node pairs down from ``depth`` and unite what lies within the budget.

    ``rot``: sorted rotated fingerprints by subtrie; ``node``: each row's index
    in ``parent``; ``pairs``: lo_a, hi_a, lo_b, hi_b and bits that differ so far.
    """
    def link(i, j):
        near = np.bitwise_count(rot[i] ^ rot[j]) <= BUDGET
        if near.any():
            _unite(parent, node[i[near]], node[j[near]])

    ones: dict[int, np.ndarray] = {}
    stack = [(depth, pairs)]
    while stack:
        d, (lo_a, hi_a, lo_b, hi_b, bits) = stack.pop()
        if len(lo_a) > FRONTIER:
            stack += [(d, [x[s: s + FRONTIER] for x in (lo_a, hi_a, lo_b, hi_b, bits)]) for s in range(0, len(lo_a), FRONTIER)]
            continue
        root = parent[node]
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        known = (turns[lo_a] == turns[hi_a - 1]) & (turns[lo_b] == turns[hi_b - 1]) & (root[lo_a] == root[lo_b])
        lo_a, hi_a, lo_b, hi_b, bits = (x[~known] for x in (lo_a, hi_a, lo_b, hi_b, bits))
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= DIRECT) | (d >= 64)
        if small.any():
            link(*_expand(lo_a[small], hi_a[small], lo_b[small], hi_b[small], (lo_a == lo_b)[small]))
        lo_a, hi_a, lo_b, hi_b, bits = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, bits))
        if not len(lo_a):
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((rot >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        mid_a, mid_b = hi_a - (ones[d][hi_a] - ones[d][lo_a]), hi_b - (ones[d][hi_b] - ones[d][lo_b])
        same = lo_a == lo_b
        below = [
            np.concatenate([lo_a, mid_a, lo_a, mid_a[~same]]), np.concatenate([mid_a, hi_a, mid_a, hi_a[~same]]),
            np.concatenate([lo_b, mid_b, mid_b, lo_b[~same]]), np.concatenate([mid_b, hi_b, hi_b, mid_b[~same]]),
            np.concatenate([bits, bits, bits + 1, bits[~same] + 1])]
        go = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= BUDGET)
        stack.append((d + 1, [x[go] for x in below]))


def _links(block: np.ndarray, pair: np.ndarray, rot: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest over the fingerprints of some subtries; ``start`` has each subtrie's first row."""
    back = (16 * block).astype(np.uint64)
    fps = (rot >> back) | np.where(block > 0, rot << ((np.uint64(64) - back) & np.uint64(63)), np.uint64(0))
    known, node = np.unique(fps, return_inverse=True)
    parent = np.arange(len(known))
    inner = np.ones(len(rot), bool)
    inner[start] = False
    i = np.flatnonzero(inner)
    near = i[np.bitwise_count(rot[i] ^ rot[i - 1]) <= BUDGET]
    _unite(parent, node[near], node[near - 1])
    end = np.append(start[1:], len(rot))
    whole = pair[start] < 0
    s, e = start[whole], end[whole]
    walk(rot, node, parent, [s, e, s, e, np.zeros(len(s), np.int64)], 16)
    s, e, p = start[~whole], end[~whole], pair[start[~whole]]
    if len(s):
        child = ((rot >> np.uint64(40)) & np.uint64(255)).astype(np.int64)
        a, b = p // 256, p % 256
        mid = np.array([lo + np.searchsorted(child[lo:hi], y) for lo, hi, y in zip(s, e, b, strict=True)], np.int64)
        own = a == b
        two = [np.where(own, mid, s), np.where(own, e, mid), mid, e, np.bitwise_count(a ^ b).astype(np.int64)]
        go = (two[0] < two[1]) & (two[2] < two[3])
        walk(rot, node, parent, [x[go] for x in two], 24)
    moved = parent != np.arange(len(known))
    return known[moved].view(np.int64), known[parent[moved]].view(np.int64)


def _walk_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole subtries in portions of about WALK_ROWS rows."""
    held: list[np.ndarray] = []
    rows = 0

    def portion(x: np.ndarray) -> pa.RecordBatch:
        block, top, pair, rot = x
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (top[1:] != top[:-1]) | (pair[1:] != pair[:-1])]))
        u, v = _links(block, pair, rot.view(np.uint64), new)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
        rows += b.num_rows
        if rows >= WALK_ROWS:
            x = np.concatenate(held, axis=1)
            last = (x[:3] != x[:3, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield portion(x[:, :cut])
            held, rows = [x[:, cut:]], x.shape[1] - cut
    if rows:
        yield portion(np.concatenate(held, axis=1))


def fingerprint_links(fps: DataFrame, hot: int = HOT_SUBTRIE) -> DataFrame:
    """(u, v) links that connect all distinct ``fp`` within the budget as the full set of links would."""
    turned = fps.select("fp").distinct().select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), F.expr(f"(fp << {16 * k}) | shiftrightunsigned(fp, {64 - 16 * k})" if k else "fp").alias("rot"))
        for k in range(4)])).alias("x")).select("x.block", F.expr("CAST(shiftrightunsigned(x.rot, 48) AS INT)").alias("top"), "x.rot")
    large = turned.groupBy("block", "top").count().filter(F.col("count") > hot).select("block", "top", F.lit(True).alias("large"))
    child = F.expr("CAST(shiftrightunsigned(rot, 40) & 255 AS INT)")
    near = F.transform(F.array(*[F.lit(d) for d in _NEAR]), lambda d: F.least(child, child.bitwiseXOR(d)) * 256 + F.greatest(child, child.bitwiseXOR(d)))
    parts = turned.join(large, ["block", "top"], "left").select(
        "block", "top", F.explode(F.when(F.col("large"), near).otherwise(F.array(F.lit(-1)))).alias("pair"), "rot")
    # the subtrie's own order is unsigned; within one top value signed order is the same
    return parts.repartition("block", "top", "pair").sortWithinPartitions("block", "top", "pair", "rot").mapInArrow(_walk_partition, "u long, v long")


def _marked(df: DataFrame, text: str, key: str, width: int, row: bool) -> DataFrame:
    """fp and key ``k`` of every row; with ``row`` also a digest of the text and all columns. Stored."""
    cols = [text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k")]
    shape = T.StructType([T.StructField("fp", T.LongType()), T.StructField("k", df.schema[key].dataType)])
    if row:
        cols += [F.sha2(text_or_empty(text), 256).alias("sha"), as_row(df).alias("row")]
        shape.add("sha", T.StringType()).add("row", df.schema)
    return stored(df.select(*cols).mapInArrow(_fingerprints(width), shape))


def _components(marked: DataFrame, hot: int) -> DataFrame:
    """fp, root (the smallest fingerprint of its component) and the smallest key of the component."""
    groups = stored(marked.groupBy("fp").agg(F.min("k").alias("k")))
    roots = star_components(fingerprint_links(groups, hot))
    rooted = groups.join(roots, groups.fp == roots.u, "left").select("fp", "k", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("k").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def simhash_groups(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, hot: int = HOT_SUBTRIE) -> DataFrame:
    """One row per row of ``df``: key, fingerprint (16 hex digits) and component_id.

    A-Z count as a-z; words are separated by the bytes 0x09-0x0D and 0x20; a
    text of fewer words than ``width`` is one shingle; null and texts without a
    word have fingerprint zero and are linked like any other. component_id is
    the smallest key reachable over fingerprints that differ in 3 bits at most;
    rows without a key are grouped too, and a group without any key has a null
    component_id. Repeated rows are rows of one group. An empty table gives no
    rows. Other columns are neither read nor renamed.
    """
    marked = _marked(df, text, key, width, False)
    return marked.join(_components(marked, hot), "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, hot: int = HOT_SUBTRIE) -> DataFrame:
    """The rows of ``df`` that stay, one per component: the smallest key, then the smallest digest of the text.

    Rows without a key stay only if their component has none. The choice is
    made on keys and digests; texts are moved once.
    """
    marked = _marked(df, text, key, width, True)
    rank = F.struct(F.col("k").isNull().alias("unnamed"), F.col("k").alias("k"), F.col("sha").alias("sha"), F.col("fp").alias("fp"))
    least = marked.groupBy("fp").agg(F.min(rank).alias("least"))
    first = least.join(_components(marked, hot), "fp").groupBy("root").agg(F.min("least").alias("first")).select("first.*").drop("unnamed")
    keys = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("fp", "k", "sha")]
    stay = marked.alias("m").join(first.alias("f"), keys[0] & keys[1] & keys[2], "left_semi")
    # rows that agree in all of these are repeats of one another
    return stay.dropDuplicates(["fp", "k", "sha"]).select("row.*")
