"""Compare every query with its SQL counterpart: ``python -m testbed.verify [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
WIDE = ("HUGEINT", "DECIMAL")


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.4f}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, fn, oracle: str, sf_dir: str) -> str:
    """Empty when both sides agree, else the difference."""
    df = fn(spark, sf_dir)
    got = df.collect()
    rel = con.execute(oracle)
    types = {d[0]: str(d[1]) for d in rel.description}
    expected = rel.fetchall()
    wide = [c for c, t in types.items() if t.upper().startswith(WIDE)]
    if wide:
        return f"wide types in the SQL: {wide}"
    if sorted(df.columns) != sorted(types):
        return f"columns: {sorted(set(df.columns) ^ set(types))}"
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    other = {c for c, t in types.items() if t.upper() in ("DOUBLE", "FLOAT")}
    if doubles != other:
        return f"types: {doubles ^ other}"
    widths = {"int": "INTEGER", "bigint": "BIGINT"}
    narrow = sorted(
        f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields
        if f.dataType.simpleString() in widths and widths[f.dataType.simpleString()] != types[f.name].upper())
    if narrow:
        return f"integer widths: {narrow}"
    a, b = _rows(df.columns, got), _rows(list(types), expected)
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} vs {len(expected)}; only spark: {left}; only sql: {right}"
    return ""


def main() -> int:
    from faultloom.session import build_session
    from testbed.registry import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("verify", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t0:.2f}s {problem}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
