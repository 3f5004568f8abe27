from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from faultloom.llm import langid
from tests.conftest import SF


class SlowModel:
    """Dictionary of contexts, byte by byte."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            data = b"\0" * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(data)):
                for k in range(langid.ORDER + 1):
                    self.after[data[i - k: i]][data[i]] += 1

    def bits(self, text):
        data, total = b"\0" * langid.ORDER + text.encode(), 0.0
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER, -1, -1):
                seen = self.after.get(data[i - k: i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total += math.log2((n + d) / seen[data[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total


TEACH = {"a": ["the cat sat", "on the mat", "é"], "b": ["der hund lief", "über die mauer", ""]}


def taught(spark):
    rows = [(t, lang, i) for lang, ts in TEACH.items() for i, t in enumerate(ts, 1000 * ord(lang))]
    rows = [(t, lang, next(j for j in range(10 * i, 10 * i + 10) if zlib.crc32(str(j).encode()) % 5)) for t, lang, i in rows]
    return spark.createDataFrame([*rows, (None, "a", 1), ("x", None, 2), ("x", "c", None)], "text string, lang string, doc_id long")


def test_code_lengths_are_exact(spark, monkeypatch):
    model = langid.learn(taught(spark))
    assert model.languages == ("a", "b")
    slow = [SlowModel(TEACH[x]) for x in model.languages]
    texts = ["the hund", "", "é", "z", "on über the mauer " * 5, "der"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for step in (1 << 20, 7, 1):
        monkeypatch.setattr(langid, "BYTES_AT_ONCE", step)
        got = langid._Scorer(model).totals(raw, offs)
        want = [[m.bits(t) for t in texts] for m in slow]
        np.testing.assert_allclose(got, want)


def test_defined_cases(spark):
    model = langid.learn(taught(spark))
    rows = [(None, 1), ("", 2), ("12 !?", 3), ("the cat", 4), ("the cat", 4), ("hund " * 100_000, None)]
    df = spark.createDataFrame([(t, i, "q", 9) for t, i in rows], "text string, doc_id long, score string, letter int")
    got = langid.predict(df, model, carry={"doc_id": F.col("doc_id")}).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "a"), ("4", "a"), ("None", "b")])
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.known_language(df, model).columns == df.columns and langid.known_language(df, model).count() == 3
    empty = langid.learn(df.limit(0).withColumn("lang", F.lit("a")))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    got = langid.predict(docs, model, carry={"lang": F.col("lang"), "out": langid.held_out("doc_id")}).filter("out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_model_from_counts():
    model = langid._model(pd.DataFrame({"lang": ["x", "x"], "gram": [0x61, 0x62], "n": [3, 1]}))
    # byte a after nothing: 3 of 4 plus 2 kinds
    assert math.isclose(model.lengths(np.array([0x61]))[0, 0], math.log2(6 / 3))
