from __future__ import annotations

import random
import string

import numpy as np
import pytest
import xxhash

from faultloom.llm import simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow_fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i: i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def slow_groups(fps):
    """Smallest position reachable over links of at most 3 bits."""
    group = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def test_fingerprint_and_groups(spark):
    rng = random.Random(3)
    words = ["Wort", "été", "the", "Of", "a", "b1"]
    texts = [None, "", " \t\n", "one", "one two", "ONE two Three", "x y z"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(300)]
    for _ in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [texts[-1]] * 40 + ["w " * 200_000]
    rows = [(t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text string, doc_id long, fp string").repartition(5)
    got = {r.doc_id: r for r in simhash.simhash_groups(df).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_groups(fps)
    kept = sorted(r.doc_id for r in simhash.one_per_group(df).collect())
    assert kept == sorted(set(slow_groups(fps)))


@pytest.mark.parametrize("hot", [5, 10_000])
def test_links_connect_like_all_pairs(spark, hot):
    rng = random.Random(hot)
    fps = {rng.getrandbits(64) for _ in range(150)} | {rng.getrandbits(30) for _ in range(50)}
    for x in list(fps):
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r.u]], fps[at[r.v]]) for r in links)
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in links:
        a, b = root(at[r.u]), root(at[r.v])
        group[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == slow_groups(fps)


def test_missing_keys_and_empty(spark):
    df = spark.createDataFrame([("a b c", None), ("a b c", 4), ("zz", None)], "text string, doc_id long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (None, None)], key=str)
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    assert simhash.one_per_group(df.limit(0)).count() == 0
