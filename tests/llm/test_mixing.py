from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultloom.llm import mixing
from tests.conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares everything by weight, caps what is above, shares the excess, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(capped) < len(names):
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in free:
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                capped.add(s)
    return target


def test_word_counts(monkeypatch):
    texts = ["", None, " a", "a b", "a\x0bb\x1cc\xa0d ", "é è", "\n", "x", " "]
    for step in (1, 3, 1 << 20):
        monkeypatch.setattr(mixing, "BYTES_AT_ONCE", step)
        assert mixing.word_counts(pa.array(texts)).tolist() == [len(WORD.findall(t or "")) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "B", "ü", "é", None, "zz", "hot", "hot", "hot", "", "10"]), rng.choice([0, 1, 5, 400])) for _ in range(60)]
    rows += [("empty", 0), ("tiny", 1)]
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = slow_targets(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want)


@pytest.mark.parametrize("bucket_rows,fan_in", [(4096, 64), (20, 3)])
def test_mix_of_documents(spark, bucket_rows, fan_in):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = lambda d: sorted(map(tuple, mixing.mixed(d, bucket_rows=bucket_rows, fan_in=fan_in).drop("copies").collect()))
    got = run(docs)
    assert got == run(docs.repartition(13).withColumn("size", docs.n_chars))
    texts = {r.doc_id: r for r in docs.collect()}
    sizes, taken, largest = {}, {}, {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = slow_targets(sizes)
    assert [g[0] for g in got] == sorted(texts)
    for doc_id, size, source_size, target, took in got:
        source = texts[doc_id].source
        assert size == len(WORD.findall(texts[doc_id].text or "")) and source_size == sizes[source]
        assert abs(target - want[source]) <= 1e-6 * (1 + target) and 0 <= took <= 3 * size and (not size or took % size == 0)
        taken[source] = taken.get(source, 0) + took
        largest[source] = max(largest.get(source, 0), size)
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)


def test_rounding_is_fair():
    """Over many seeds each document goes up as often as its fraction says."""
    ups = np.zeros(5)
    sizes, parts = [1, 7, 3, 2, 10], [0.3, 0.5, 0.2, 0.9, 0.4]
    for seed in range(4000):
        p = mixing._Pivot([seed])
        for i, (s, x) in enumerate(zip(sizes, parts, strict=True)):
            for r, up in p.add(i, s, x):
                ups[r] += up
        if p.open:
            ups[p.open[0]] += p.random.random() < p.open[2]
    assert np.abs(ups / 4000 - parts).max() < 0.04


def test_defined_cases(spark):
    rows = [(None, None, None), ("", 1, None), ("a b", None, "s"), ("a b", None, "s"), ("w " * 50_000, 2, "s"), ("q", 3, "t")]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and all(r.copies in (0, 1, 2, 3) for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.take_copies(df).columns == df.columns
    assert mixing.take_copies(df).count() == sum(r.copies for r in got)
    assert mixing.take_copies(df.limit(0)).count() == 0


def test_repeated_rows_are_cut_into_buckets(spark):
    rows = [("twice and more", 1, "a")] * 1000 + [("other", 2, "b")] * 300 + [(f"w {i}", i, "a") for i in range(3, 703)]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string")
    sized = df.repartition(3).select(F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("at"), "doc_id").localCheckpoint()
    got = mixing._bucketed(sized, 40, 50).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[1] for r in rows)
    assert max(Counter(r.node for r in got).values()) <= 150 and max(Counter((r.node, r.doc_id) for r in got).values()) <= 50
    run = lambda d: sorted(map(tuple, mixing.mixed(d, bucket_rows=50, fan_in=3).collect()))
    assert run(df) == run(df.repartition(7)) and len(run(df)) == 2000
