"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into a leaf. A
query goes through the tree best bin first: a priority queue holds the nodes
seen so far by distance to their centre, and leaves are taken from it in that
order. How many leaves are visited is calibrated: the true neighbours of a
bounded set of calibration rows, found among all rows by brute force, say how
far the search must widen to reach the wanted recall. Visited leaves are
searched in blocks of queries against blocks of rows, so a leaf that holds a
large part of all rows is shared out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import stored

#: Rows the tree is fitted on, and rows whose true neighbours calibrate it (both drawn by a hash of the key).
SAMPLE_ROWS, CALIBRATION_ROWS = 20_000, 200
BRANCHES, LEAF_ROWS, ROUNDS = 12, 48, 8
#: Share of true neighbours that must lie in the leaves visited.
RECALL = 0.97
#: Queries of a task that walks the tree.
TASK_QUERIES = 128
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048
SEED = 7


@dataclass(frozen=True)
class Tree:
    """``children[i]``: inner nodes' children, empty for a leaf; ``leaf[i]``: a leaf's number, else -1."""

    centres: np.ndarray
    children: tuple[np.ndarray, ...]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _squares(x[rows], self.centres[below]).argmin(axis=1)
                stack += [(int(c), rows[near == k]) for k, c in enumerate(below)]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which the priority queue gives them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                yield int(self.leaf[node])
            else:
                for d, c in zip(((self.centres[below] - q) ** 2).sum(axis=1).tolist(), below.tolist(), strict=True):
                    heapq.heappush(queue, (d, c))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None] - 2 * (a @ b.T)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, np.int64)], [-1]
    stack, leaves = [(0, x)], 0
    while stack:
        node, rows = stack.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf_rows:
            means = rows[rng.choice(len(rows), branches, replace=False)]
            for _ in range(ROUNDS):
                near = _squares(rows, means).argmin(axis=1)
                used = np.unique(near)
                means = np.stack([rows[near == k].mean(axis=0) for k in used])
            near = _squares(rows, means).argmin(axis=1)
            parts = [rows[near == k] for k in range(len(means)) if (near == k).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        ids = np.arange(len(centres), len(centres) + len(parts))
        children[node] = ids
        for i, part in zip(ids.tolist(), parts, strict=True):
            centres.append(part.mean(axis=0))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            stack.append((i, part))
    return Tree(np.stack(centres), tuple(children), np.array(leaf))


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows of each query in double precision, ties to the smaller key.

    A query's own row is left out, and all that ``allowed`` (queries by rows) excludes.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rough = _squares(q, x)
    rough[q_ids[:, None] == ids[None]] = np.inf
    if allowed is not None:
        rough[~allowed[:, order]] = np.inf
    # the expanded form is inexact: take all rows that rounding may have put behind the k-th, then measure exactly
    kth = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    slack = 1e-9 * ((q ** 2).sum(axis=1) + (x ** 2).sum(axis=1).max()) + 1e-300
    out = []
    for i in range(len(q)):
        near = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & (rough[i] < np.inf))
        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        best = np.argsort(exact, kind="stable")[:k]
        out.append((np.full(len(best), q_ids[i]), ids[near[best]], exact[best]))
    return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _usable(vector: str) -> Column:
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))


def _draw(rows: int, total: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, rows / max(1, total))))


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t.column(0).to_numpy().astype(np.int64), _matrix(t.column(1))


def _brute(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            for s in range(0, len(ids), BLOCK_ROWS):
                yield pa.RecordBatch.from_pandas(nearest(q_ids, q, ids[s: s + BLOCK_ROWS], x[s: s + BLOCK_ROWS], k), preserve_index=False)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries among all rows (id, v)."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    return _top(rows.mapInArrow(_brute(shared, k), "query_id long, vec_id long, score double"), k)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(_matrix(b.column(1))) if b.num_rows else [], pa.int64())], ["id", "v", "leaf"])

    return run


def _visit(shared, visits: int, sizes: np.ndarray, bins: np.ndarray, least: int):
    """A row per query and bin that holds leaves to visit, with these leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            rows, where, leaves = [], [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else ()):
                seen, chosen = 0, {}
                for n, leaf in enumerate(tree.best_first(q)):
                    if n >= visits and seen >= least:
                        break
                    seen += int(sizes[leaf])
                    if sizes[leaf]:
                        chosen.setdefault(int(bins[leaf]), []).append(leaf)
                rows += [i] * len(chosen)
                where += chosen
                leaves += chosen.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(where, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["q_id", "q", "bin", "leaves"])

    return run


def _search(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not rows.num_rows:
            return shape.empty_table()
        leaf = rows.column("leaf").to_numpy()
        visited = [np.isin(leaf, x) for x in queries.column("leaves").to_pylist()]
        found = nearest(queries.column("q_id").to_numpy(), _matrix(queries.column("q")), rows.column("id").to_numpy(), _matrix(rows.column("v")), k, np.stack(visited))
        return pa.Table.from_pandas(found, schema=shape, preserve_index=False)

    return run


@dataclass(frozen=True)
class Index:
    """All usable rows (id, v, leaf), the tree, rows per leaf, and the calibrated number of leaves to visit."""

    rows: DataFrame
    tree: Tree
    sizes: np.ndarray
    visits: int


def build_index(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 10, recall: float = RECALL) -> Index | None:
    """An index of all usable rows; None if there is none.

    Rows without a key, and vectors that are null, zero or hold null or
    non-finite components take no part, nor do those whose length is not the
    most frequent one (of equals the largest). Repeated rows are rows each.
    Other columns are neither read nor renamed.
    """
    rows = df.filter(F.col(f"`{key}`").isNotNull() & _usable(vector)).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    rows, total = rows.filter(F.size("v") == length["d"]), length["count"]
    tree = fit_tree(_collect(rows.filter(_draw(SAMPLE_ROWS, total, 1)))[1].reshape(-1, length["d"]))
    shared = df.sparkSession.sparkContext.broadcast(tree)
    placed = stored(rows.mapInArrow(_assign(shared), T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])))
    sizes = np.zeros(tree.leaves, np.int64)
    # a row per leaf
    for r in placed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    probes = _collect(rows.filter(_draw(CALIBRATION_ROWS, total, 2)))
    visits = tree.leaves
    if len(probes[0]):
        true = brute_force(rows, probes, k).join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").toPandas()
        vectors = dict(zip(probes[0].tolist(), probes[1], strict=True))
        order = {q: {leaf: n for n, leaf in enumerate(tree.best_first(v), 1)} for q, v in vectors.items()}
        needed = np.sort([order[q][leaf] for q, leaf in zip(true["query_id"], true["leaf"], strict=True)])
        if len(needed):
            visits = int(needed[math.ceil(recall * len(needed)) - 1])
    return Index(placed, tree, sizes, visits)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each of ``queries`` (id, v), all of usable vectors."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index.tree)
    # neighbouring leaves share a bin of about BLOCK_ROWS rows; a larger leaf has its own, cut into parts
    bins, held = np.zeros(index.tree.leaves, np.int64), 0
    for leaf, n in enumerate(index.sizes.tolist()):
        new = leaf and (held + n > BLOCK_ROWS)
        bins[leaf], held = (bins[leaf - 1] + bool(new) if leaf else 0), n if new else held + n
    rows_of = np.bincount(bins, index.sizes)
    shape = T.StructType([
        T.StructField("q_id", T.LongType()), T.StructField("q", queries.schema["v"].dataType), T.StructField("bin", T.LongType()), T.StructField("leaves", T.ArrayType(T.LongType()))])
    # the traversal is heavy for its bytes, so queries are dealt by their number
    queries = stored(queries)
    queries = queries.repartition(max(1, math.ceil(queries.count() / TASK_QUERIES)))
    asked = stored(queries.mapInArrow(_visit(shared, index.visits, index.sizes, bins, k + 1), shape))
    # a row per bin says into how many parts its rows and its queries are cut
    asks = {r["bin"]: r["count"] for r in asked.groupBy("bin").count().collect()}
    cuts = spark.createDataFrame(
        [(b, max(1, math.ceil(rows_of[b] / BLOCK_ROWS)), math.ceil(n / BLOCK_QUERIES)) for b, n in asks.items()] or [(-1, 1, 1)], "bin long, row_parts int, query_parts int")
    of = spark.createDataFrame(list(enumerate(bins.tolist())), "leaf long, bin long")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cuts, "bin").withColumn("query_part", part("q_id", "query_parts")).withColumn("row_part", every("row_parts"))
    right = index.rows.join(of, "leaf").join(cuts, "bin").withColumn("row_part", part("id", "row_parts")).withColumn("query_part", every("query_parts"))
    keys = ["bin", "row_part", "query_part"]
    found = left.select(*keys, "q_id", "q", "leaves").groupBy(*keys).cogroup(right.select(*keys, "id", "v", "leaf").groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, chosen: Column | str, vector: str = "embedding", key: str = "vec_id", k: int = 10) -> DataFrame:
    """The k nearest rows found for each row of ``df`` that ``chosen`` selects (a condition on the key, as column ``id``).

    Candidates are all rows but those with the query's own key. Of query rows
    that share a key the one with the smallest vector is asked. No usable
    vector gives no rows.
    """
    index = build_index(df, vector, key, k)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.filter(chosen).groupBy("id").agg(F.min("v").alias("v"))
    return search(index, queries, k)
