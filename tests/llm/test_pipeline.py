from __future__ import annotations

import string

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.conftest import SF
from tests.llm.test_mixing import WORD, slow_targets
from tests.llm.test_packing import PATH, ids_of
from tests.llm.test_simhash import slow_fingerprint, slow_groups

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's rows, from a small table with planted cases."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.filter("lang = 'en' AND length(text) > 2000").orderBy("doc_id").first().text
    planted = [(9001, words), (9002, words.upper()), (9003, words), (9004, words + " zz"), (9005, None), (9006, "123 !!"), (9007, "")]
    extra = spark.createDataFrame([(i, t, None, "src1", 1) for i, t in planted], docs.schema)
    out = [docs.unionByName(extra)]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, out[-1], SF).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_drops_what_has_no_letters_only(steps):
    lost = {r[0] for r in rows(steps[0])} - {r[0] for r in rows(steps[1])}
    assert lost == {r[0] for r in rows(steps[0]) if not any(c.isalpha() for c in r[1] or "")} >= {9005, 9006, 9007}


def test_exact_dedup(steps):
    last = {}
    for r in rows(steps[1]):
        norm = r[1].translate(LOWER)
        last[norm] = max(last.get(norm, r), r, key=lambda x: x[0])
    assert rows(steps[2]) == sorted(last.values(), key=str)
    assert {9001, 9002}.isdisjoint(r[0] for r in last.values())


def test_near_dedup(steps):
    before = sorted(rows(steps[2]), key=lambda r: r[0])
    groups = slow_groups([slow_fingerprint(r[1]) for r in before])
    assert rows(steps[3]) == sorted((before[i] for i in set(groups)), key=str)


def test_mix(steps):
    sizes, taken, largest, known = {}, {}, {}, set(rows(steps[3]))
    for r in known:
        n = len(WORD.findall(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
    after = rows(steps[4])
    assert set(after) <= known and max(after.count(r) for r in set(after)) <= 3
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + len(WORD.findall(r[1]))
    assert all(abs(taken.get(s, 0) - t) <= largest[s] + 1e-6 for s, t in slow_targets(sizes).items())


def test_pack(steps):
    library = Tokenizer.from_file(PATH)
    want = sum(len(ids_of(library, r[1])) for r in rows(steps[4]))
    got = steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(r.n for r in got) == want and all(r.n == r.end <= 4096 and r.n.bit_count() == 1 for r in got)


def test_run(spark, steps):
    assert cp.run(spark, SF).columns == steps[5].columns
