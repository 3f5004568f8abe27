from __future__ import annotations

import random
import string

import numpy as np
import pytest

from faultloom.llm import jaccard

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow_set(text, width=3):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1)))


def slow_groups(texts, percent=90, width=3):
    """Smallest position reachable over links, over all pairs."""
    sets = [slow_set(t, width) for t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def groups(spark, texts, **how):
    # other columns carry the names of inner ones
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in enumerate(texts)], "text string, doc_id long, gram string, n int").repartition(5)
    out = jaccard.similar_groups(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    return [got[i].n_shingles for i in range(len(texts))], [got[i].component_id for i in range(len(texts))]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        what = rng.randrange(3)
        if what == 0:
            w[at] = f"new{rng.randrange(10 ** 6)}"
        elif what == 1:
            del w[at]
        else:
            w.insert(at, f"more{rng.randrange(10 ** 6)}")
    return w


def test_families_passages_and_defined_cases(spark):
    rng = random.Random(1)
    vocabulary = [f"Wort{i}" for i in range(300)] + ["été", "of", "The"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one  Two", "one two three", "x y z", "a b a b a b a", "b a b a b a b"]
    passage = prose(60)
    texts += [" ".join([*prose(rng.randrange(100)), *passage, *prose(rng.randrange(100))]) for _ in range(60)]
    for size in (20, 60, 150, 400):
        base = prose(size)
        for n in range(25):
            w = edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8, 12]) * size // 150 + (n % 3 > 0))
            texts.append(rng.choice([" ", "\n", "  "]).join(w if n % 4 else [x.upper() for x in w]))
    texts += [texts[30]] * 50
    # a chain whose ends are not similar
    chain = prose(200)
    for i in range(30):
        chain[6 * i] = f"link{i}"
        texts.append(" ".join(chain))
    texts.append("w " * 50_000 + "end")
    texts.append(" ".join(f"v{i}" for i in range(20_000)))
    texts.append(" ".join(f"v{i}" for i in range(400, 20_200)))
    want = slow_groups(texts)
    assert len(set(want[1])) < len(texts) - 100
    assert groups(spark, texts) == want
    # few counters: another order, the same links
    assert groups(spark, texts, counters=4, parts=2) == want


@pytest.mark.parametrize("percent", [70, 95])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 12, 40, 90]))]
        texts += [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(10)]
    assert groups(spark, texts, percent=percent, width=2) == slow_groups(texts, percent, 2)


def test_missing_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([("a b c d", None), ("a b c d", 4), ("A b\tc d", 9), ("zz", None), (None, None), ("", 7), ("", 6), ("q r s", 5), ("t u v", 5)], "text string, doc_id long")
    got = sorted(map(tuple, jaccard.similar_groups(df).collect()), key=str)
    want = [(None, 2, 4), (4, 2, 4), (9, 2, 4), (None, 1, None), (None, 0, None), (7, 0, 7), (6, 0, 6), (5, 1, 5), (5, 1, 5)]
    assert got == sorted(want, key=str)
    assert jaccard.similar_groups(df.limit(0)).count() == 0
    assert sorted(r.component_id for r in jaccard.similar_groups(df.filter("text = ''")).collect()) == [6, 7]


def test_hashes_count_distinct_grams(monkeypatch):
    rng = random.Random(3)
    for size in (7, 1 << 18):
        monkeypatch.setattr(jaccard, "WORDS_AT_ONCE", size)
        for n in (0, 1, 2, 3, 4, 50, 300):
            text = b" ".join(b"%d" % rng.randrange(9) for _ in range(n))
            h = jaccard.gram_hashes(text, 3)
            assert len(h) == len(jaccard.grams(text, 3)) and np.array_equal(h, np.unique(h))


def test_prefix_is_long_enough():
    for percent in (70, 90, 95):
        for n in range(1, 300):
            p = jaccard.prefix_length(n, percent)
            # sharing nothing in the prefix leaves too little, one n-gram fewer in it would not do
            assert 100 * (n - p) < percent * n <= 100 * (n - p + 1)
