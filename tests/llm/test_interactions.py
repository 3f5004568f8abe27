from __future__ import annotations

import random
import re
from itertools import permutations

from faultloom.llm import interactions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow(docs, labels):
    """The definition, document by document and order by order."""
    texts = [t or "" for _, _, t in docs]
    fails = []
    for (k, _, _), t in zip(docs, texts, strict=True):
        w = WORDS.findall(t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and any(o == t and j is not None and j < k for (j, _, _), o in zip(docs, texts, strict=True))}
        fails.append({f for f, is_bad in bad.items() if is_bad})
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    out = {}
    for part in {s or "" for _, s, _ in docs}:
        rows = [(k, f) for (k, s, _), f in zip(docs, fails, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + removed
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), redundant, sum(r[1] == {f} for r in rows), sum(k in good for k, _ in removed), sum(k in toxic for k, _ in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def frames(spark, docs, labels):
    # other columns carry the names of inner ones
    df = spark.createDataFrame([(t, k, s, 0, "x", 9) for k, s, t in docs], "text string, doc_id long, source string, bits int, t string, n int").repartition(5)
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["lower", "Upper", "a", "b", "CAPS", "été", "ONE", "two", " \t", "\n", "\x0b"]
    docs = []
    for k in range(260):
        n = rng.choice([0, 1, 5, 199, 200, 201, 260])
        w = [f"{rng.choice(parts)}{rng.randrange(rng.choice([3, 400]))}" for _ in range(n)]
        docs.append((k, rng.choice(["s1", "s2", None, ""]), rng.choice([" ", "\n\x0c"]).join(w) + rng.choice(["", "", " #", "|", " $ "])))
    docs += [(1000 + i, rng.choice(["s1", "s3"]), docs[7][2]) for i in range(40)]
    docs += [(300, "s1", None), (301, "s1", ""), (-5, None, docs[3][2]), (None, "s1", docs[4][2]), (None, "s2", docs[4][2]), (302, "s2", docs[4][2])]
    docs += [docs[9], docs[9], (9, "s2", docs[9][2]), (9, "s1", "another text of the same key"), (500, "s4", "x " * 50_000 + "Y" * 5000), (501, "s4", "\xa0 " * 10)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (7, 0, 0)]
    got = result(interactions.interactions(*frames(spark, docs, labels)))
    assert got == slow(docs, labels)


def test_limits_of_the_conditions(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [
        (1, "s", " ".join(words)), (2, "s", " ".join(words[:199])), (3, "s", " ".join(words[:100] * 2)), (4, "s", " ".join([*words[:99], *words[:101]])),
        (5, "s", "X" * 2 + "y" * 98), (6, "s", "X" * 2 + "é" * 97), (7, "s", "X" * 2 + "é" * 98), (8, "s", "a%b")]
    got = result(interactions.interactions(*frames(spark, docs, [(1, 1, 1)])))
    assert got == slow(docs, [(1, 1, 1)])


def test_empty_tables(spark):
    df, labels = frames(spark, [(1, "s", "text"), (2, "s", "text")], [(1, 1, 0)])
    assert result(interactions.interactions(df.limit(0), labels)) == {}
    got = result(interactions.interactions(df, labels.limit(0)))
    assert len(got) == 600 and all(v[4:6] == (0, 0) for v in got.values())
    assert got["s", "EABCD", 1][:2] == (1, 1)
