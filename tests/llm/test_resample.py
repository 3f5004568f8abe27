from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import xxhash

from faultloom.llm import resample as rs
from tests.conftest import SF

M = 1 << 64


def slow_features(text, buckets):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh32_intdigest(w, rs.SEED) for w in words]
    pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % M) >> 32 for a, b in zip(h, h[1:], strict=False)]
    return [x % buckets for x in [*h, *pairs]]


def slow_weights(rows, good, buckets):
    total, target = Counter(), Counter()
    for k, t in rows:
        f = slow_features(t, buckets)
        total.update(f)
        if k in good:
            target.update(f)
    a, g = sum(total.values()) + buckets, sum(target.values()) + buckets
    return [sum(math.log((target[x] + 1) / g) - math.log((total[x] + 1) / a) for x in slow_features(t, buckets)) for _, t in rows]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rs, "WORDS_AT_ONCE", 7)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("Aa b c É d e f".split()) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(300, None), (301, ""), (None, "a b"), (5, "repeated row"), (5, "repeated row")]
    good = {i for i in range(0, 200, 3)}
    labels = [(i, 1) for i in good] + [(i, 0) for i in range(1, 200, 3)] + [(None, 1), (2, None), (0, 1)]
    df = spark.createDataFrame([(t, k, 1.0) for k, t in rows], "text string, doc_id long, log_weight double").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = rs.resampled(df, lab, buckets=512).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), round(w, 6)) for (k, _), w in zip(rows, slow_weights(rows, good, 512), strict=True))
    assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in got) == want
    cut = sorted((r.gumbel_key for r in got), reverse=True)[math.ceil(len(rows) / 2) - 1]
    assert all(r.selected == (r.gumbel_key >= cut) for r in got)
    assert rs.resampled(df.limit(0), lab, buckets=64).count() == 0
    assert rs.resampled(df, lab.limit(0), buckets=64).count() == len(rows)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [5, 5, 5, -1, 0, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "order long")
    down = sorted(values, reverse=True)
    for k in (1, 2, 60, 104, 150, len(values)):
        assert rs.kth_largest(df, k) == down[k - 1]


def test_selected_text_is_like_the_target(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = rs.resampled(docs, labels).join(labels, "doc_id").toPandas()
    mean = (got["log_weight"] / got["grams"].clip(lower=1)).to_numpy()
    good, bad = mean[got["quality"] == 1], mean[got["quality"] == 0]
    # chance that a good document weighs more than a bad one
    assert np.mean(good[:, None] > bad[None]) > 0.8
    assert got[got["selected"]]["quality"].mean() > got["quality"].mean()
