"""The stored trace product: eight tables, appended run by run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.operators import traces
from faultloom.sources import writers

_BUILD: dict[str, Callable[[DataFrame], DataFrame]] = {
    "trace_requests": traces.trace_requests, "trace_nodes": traces.trace_nodes, "trace_sql_events": traces.trace_sql_events,
    "trace_planner_events": traces.trace_planner_events, "trace_node_scores": traces.trace_node_scores,
    "trace_prompt_scores": traces.trace_prompt_scores, "trace_prompt_versions": traces.trace_prompt_versions,
}
TABLES = (*_BUILD, "prompt_inventory")
DAY, BATCH = "event_date", "batch"
#: Parts of one size that are merged into one; writes of small tables that run side by side.
FAN, AT_ONCE = 20, 4
_COMMIT = "seq long, live array<struct<part: string, level: int>>, schemas map<string, string>"


@dataclass(frozen=True)
class _State:
    """What the newest commit says: the parts that count, with how often their rows were merged, and each table's columns."""

    seq: int = 0
    live: tuple[tuple[str, int], ...] = ()
    schemas: dict[str, T.StructType] = field(default_factory=dict)


class TraceStore:
    """Trace tables under one folder, in parts that are sorted by day and request.

    An append writes one part of every table and then a commit, a row that
    names all parts that count and the columns of all tables. A reader takes
    the newest commit, so it sees whole appends only, reads no footer for the
    schema and lists no other folder. A part without a commit, of an append
    that failed half-way, is nobody's input, whatever name the append is
    repeated under. When ``FAN`` parts of one size have come together they are
    merged into one, so a day lies in a bounded number of files and a row is
    rewritten as often as the store grows by that factor. One writer at a time;
    folders and commits that no longer count are left to the folder's owner.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan

    def _state(self) -> _State:
        path = f"{self.folder}/commits"
        if not writers.exists(self.spark, path):
            return _State()
        last = self.spark.read.schema(_COMMIT).parquet(path).agg(F.max_by(F.struct("live", "schemas"), "seq").alias("x"), F.max("seq").alias("seq")).first()
        if last["x"] is None:
            return _State()
        return _State(
            last["seq"], tuple((p["part"], p["level"]) for p in last["x"]["live"]), {n: T.StructType.fromJson(json.loads(s)) for n, s in last["x"]["schemas"].items()})

    def _commit(self, state: _State) -> None:
        row = (state.seq, list(state.live), {n: s.json() for n, s in state.schemas.items()})
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def path(self, name: str, part: str) -> str:
        return f"{self.folder}/{name}/part={part}"

    def has(self, name: str) -> bool:
        return name in self._state().schemas

    def table(self, name: str) -> DataFrame:
        """All stored rows; row groups of other days than a query's ``event_date`` are skipped, and columns pruned."""
        state = self._state()
        if name not in state.schemas:
            raise ValueError(f"nothing is stored in {name}")
        return self._rows(name, state.schemas[name], [p for p, _ in state.live])

    def _rows(self, name: str, schema: T.StructType, parts: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}")
        return reader.parquet(*[self.path(name, p) for p in parts]).select(*[f"`{c}`" for c in schema.names])

    def payloads(self) -> DataFrame:
        return self.table("payloads")

    def append(self, payloads: DataFrame, batch: str) -> None:
        """Adds the payloads whose request is not stored yet, under the name ``batch``.

        Of a request that comes twice the newest payload is taken, of equally
        new ones always the same. Requests without an id are left out.
        """
        state = self._state()
        columns = payloads.columns
        age = F.struct("ts", F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in columns]))))
        fresh = payloads.filter("request_id <> ''").groupBy("request_id").agg(F.max_by(F.struct(*[f"`{c}`" for c in columns]), age).alias("p")).select("p.*")
        live = [p for p, _ in state.live]
        if live:
            known = self._rows("trace_requests", state.schemas["trace_requests"], live).select("request_id")
            fresh = fresh.join(known, "request_id", "left_anti")
        part, schemas = f"p{uuid.uuid4().hex}", dict(state.schemas)
        schemas["payloads"] = self._put("payloads", fresh, part, batch, schemas.get("payloads"), dealt=True)
        mine = self._rows("payloads", schemas["payloads"], [part]).drop(BATCH, DAY)
        if live:
            inventory = self._rows("prompt_inventory", schemas["prompt_inventory"], live)
        else:
            inventory = self.spark.createDataFrame([], "prompt_key string, prompt_version string")
        build = {n: f(mine) for n, f in _BUILD.items()} | {"prompt_inventory": traces.prompt_inventory_new(mine, inventory)}
        # small jobs that wait for one another leave most cores idle
        with ThreadPoolExecutor(AT_ONCE) as pool:
            made = {n: pool.submit(self._put, n, df, part, batch, schemas.get(n)) for n, df in build.items()}
            schemas |= {n: m.result() for n, m in made.items()}
        self._commit(_State(state.seq + 1, (*state.live, (part, 0)), schemas))
        self.compact()

    def _put(self, name: str, df: DataFrame, part: str, batch: str | None, target: T.StructType | None, dealt: bool = False) -> T.StructType:
        """Writes a part of a table; gives the table's columns, those that are new at the end. Rows that are ``dealt`` evenly move no more."""
        if batch is not None:
            if name != "prompt_inventory":
                df = df.withColumn(DAY, F.to_date("ts"))
            df = df.withColumn(BATCH, F.lit(batch))
        if target:
            df = writers.evolve_schema(df, target)
        by = [*([DAY] if DAY in df.columns else []), "request_id" if "request_id" in df.columns else "prompt_key"]
        # a merged part goes by ranges of days, an append is mostly one file; statistics skip the days a query leaves out
        if batch is None:
            df = df.repartitionByRange(*by)
        elif not dealt:
            df = df.hint("rebalance")
        df.sortWithinPartitions(*by).write.parquet(self.path(name, part))
        return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])

    def compact(self) -> int:
        """Merges parts of one size where ``fan`` of them have come together; gives the number of merges.

        A reader that has taken its commit before goes on with the old parts.
        """
        merges = 0
        while True:
            state = self._state()
            levels = [n for _, n in state.live]
            level = next((n for n in sorted(set(levels)) if levels.count(n) >= self.fan), None)
            if level is None:
                return merges
            old, new = [p for p, n in state.live if n == level], f"p{uuid.uuid4().hex}"
            with ThreadPoolExecutor(AT_ONCE) as pool:
                made = [pool.submit(self._put, n, self._rows(n, s, old), new, None, None) for n, s in state.schemas.items()]
                for m in made:
                    m.result()
            rest = tuple(x for x in state.live if x[0] not in old)
            self._commit(_State(state.seq + 1, (*rest, (new, level + 1)), state.schemas))
            merges += 1
