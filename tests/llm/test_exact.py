from __future__ import annotations

import hashlib
import random
import string
from collections import defaultdict

import pytest

from faultloom.llm.exact import exact_groups

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, largest):
    groups = defaultdict(list)
    for text, key in rows:
        groups[(text or "").translate(LOWER)].append(key)
    out = []
    for norm, keys in groups.items():
        named = [k for k in keys if k is not None]
        keep = (max if largest else min)(named) if named else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        left = 1
        for k in sorted(keys, key=lambda k: k != keep):
            out.append((k, keep, len(keys), left == 1, sha))
            left = 0
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    long = "x" * 300_000
    rows = [(None, 1), ("", 2), ("A b", 3), ("a B", 4), ("a  b", 5), ("É", 6), ("é", 7), (long, 8), (long.upper(), 9), (long + "y", 10),
            ("dup", 11), ("dup", 11), ("none", None), ("none", None), ("some", None), ("some", 12)]
    rows += [("hot", i) for i in range(100, 1100)] + [(f"t{i % 400}", i) for i in range(2000, 3500)]
    df = spark.createDataFrame([(t, k, "s", 1) for t, k in rows], "text string, doc_id long, norm string, run int").repartition(7)
    got = exact_groups(df, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, keep == "largest")


def test_hot_text_is_spread(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'same' AS text")
    got = exact_groups(df)
    assert got.filter("kept").collect()[0][:3] == (0, 0, 20_000)
    assert got.filter("kept").count() == 1


def test_empty_and_row(spark):
    df = spark.createDataFrame([], "text string, doc_id long")
    assert exact_groups(df).count() == 0
    df = spark.createDataFrame([("a", 1, 5), ("A", 2, 6)], "text string, doc_id long, kept int")
    got = exact_groups(df, row=True).filter("kept").select("row.*").collect()
    assert [tuple(r) for r in got] == [("a", 1, 5)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_runs_over_many_batches_and_partitions(spark, keep):
    """A run goes on over batches and partitions; no row waits for its end."""
    rng = random.Random(2)
    rows = [("Same text", i) for i in range(700)] + [(f"t{rng.randrange(60)}", 1000 + i) for i in range(400)] + [(None, 5000), ("", 5001), ("same TEXT", 300)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = exact_groups(spark.createDataFrame([(t, k, 1) for t, k in rows], "text string, doc_id long, run int").repartition(6), keep=keep, row=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for t, k in rows:
        groups.setdefault((t or "").lower(), []).append(k)
    pick = min if keep == "smallest" else max
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((k, pick(ks), len(ks)) for ks in groups.values() for k in ks)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(pick(ks) for ks in groups.values())
    assert all(r.row.doc_id == r.doc_id and (r.row.text or "").lower() in groups for r in got)
