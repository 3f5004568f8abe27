from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from faultloom.llm import gains
from tests.conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return len(w), [" ".join(w[i: i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def slow(docs, benchmark):
    """doc_id, n_features, weight, score, rank by the definition."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, slow_features(text)[1]))
    for text in benchmark:
        t.update(map(bucket, slow_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows, enough = [], []
    for k, text in docs:
        n, f = slow_features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            enough.append(rows[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: 5 * len(enough) // 100], 1):
        r[4] = i
    return sorted(map(tuple, rows), key=str)


def result(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in df.schema.fields} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def frames(spark, docs, benchmark):
    df = spark.createDataFrame([(t, k, 1, "x", 0) for k, t in docs], "text string, doc_id long, score int, name string, pid int").repartition(4)
    return df, spark.createDataFrame([(t, i) for i, t in enumerate(benchmark)], "text string, item_id long")


@pytest.mark.parametrize("seed", [5, 6])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = ["The", "of", "É1", "ü", "x9", "a", "b", "-", "\x00", "\x7f", "中文", "\xa0", "a_b", "c'd", "Z" * 40, "q" * 300]
    docs = [(i, rng.choice([" ", "", "\n", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(90)))) for i in range(260)]
    docs += [(900, None), (901, ""), (902, "one"), (903, "one two"), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (904, "w" * 70_000 + " end"), (905, "the of " * 9_000)]
    docs += [(i, "the same twenty words " * 5) for i in range(2000, 2060)]
    benchmark = [docs[5][1], None, "", "the same twenty words of the", "unseen words only"]
    df, target = frames(spark, docs, benchmark)
    assert result(gains.drawn(df, target)) == slow(docs, benchmark)


def test_small_blocks_give_the_same(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))) for _ in range(80)] + ["", "x" * 400 + " y", "a b c"]
    batch = pa.record_batch([pa.array(texts)], ["t"])

    def counted():
        found, words = Counter(), np.zeros(len(texts), np.int64)
        for n, table, owner in gains._blocks(batch, 3, 10_000):
            words += n
            found.update(zip(owner.tolist(), table.bucket[table.slot].tolist(), strict=True))
        return found, words.tolist()

    want = Counter((i, bucket(f)) for i, t in enumerate(texts) for f in slow_features(t)[1])
    for size, words in ((1, 1), (50, 3), (1 << 20, 7), (1 << 20, 1 << 17)):
        monkeypatch.setattr(gains, "BYTES_AT_ONCE", size)
        monkeypatch.setattr(gains, "BLOCK_WORDS", words)
        assert counted() == (want, [len(t.split()) for t in texts])


def test_keys_and_checksums_equal_the_libraries():
    rng = np.random.default_rng(1)
    buf = gains.Buffer(rng.integers(0, 256, 6000, dtype=np.uint8))
    length = rng.choice([*range(1, 70), 95, 96, 97, 255, 256, 257, 300], 4000)
    start = rng.integers(0, 5600, 4000)
    cut = [buf.slice(s, s + n) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    assert gains.keys_of(buf, start, length).tolist() == [xxhash.xxh64_intdigest(c) for c in cut]
    assert gains.crcs_of(buf, start, length).tolist() == [zlib.crc32(c) for c in cut]


def test_equal_keys_of_unequal_slices_are_told_apart():
    words = [b"aa", b"ab", b"aa", b"ac", b"abcdefghij", b"abcdefghik", b"ab", b"x" * 300, b"x" * 299 + b"y", b"x" * 300]
    line = np.frombuffer(b" ".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length + 1) - length - 1
    table = gains.Interned(gains.Buffer(line), start, length, 10_000, keys=np.full(len(words), 13, np.uint64))
    same = {w: set() for w in words}
    for w, s in zip(words, table.slot.tolist(), strict=True):
        same[w].add(s)
    assert all(len(s) == 1 for s in same.values()) and len(table.used) == len(same) == len(set.union(*same.values()))
    for w, (s,) in same.items():
        assert table.count[s] == words.count(w) and table.bucket[s] == zlib.crc32(w) % 10_000


def test_documents_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()])
    assert result(gains.drawn(docs, benchmark)) == want
    assert gains.drawn(docs.limit(0), benchmark).count() == 0
    assert result(gains.drawn(docs, benchmark.limit(0))) == slow([(r.doc_id, r.text) for r in docs.collect()], [])
