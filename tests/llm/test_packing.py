from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultloom.llm import packing
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_tokenizer_equals_library(library):
    rng = random.Random(5)
    alphabet = "aAzZéÉßΣσςİi'’'sT t́\xa0\x1c\x85\x00\t\n\r <|endoftext|>|<>0129½中文한글K,,..;:!?-_=﻿\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|>B, c.", "<|EndOfText|>", "it's, l'été. end?! (x).", "a.", ".", "b,", ",c d! e?? f;"]
    # every character of the first blocks between letters and marks, and words of letters only
    texts += [f"ab{chr(c)}c {chr(c)} ({chr(c)}x, x{chr(c)}) x{chr(c)}\u0301" for c in range(1, 0x600)]
    texts += [f"ÀB{chr(c)}&&&  {chr(c)}.!! x{chr(c)}%%%%% {chr(c)}×, É{chr(c)}÷. ŒUF{chr(c)}" for c in range(1, 0x600)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüßñçèœ") for _ in range(rng.randrange(1, 15))) for _ in range(3000)]
    tok = packing.WordTokenizer(PATH)
    for at in range(0, len(texts), 500):
        part = texts[at: at + 500]
        raw = np.frombuffer("".join(part).encode(), np.uint8)
        offs = np.cumsum([0, *(len(t.encode()) for t in part)])
        got = [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(raw, offs)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part]


def check(rows, library, texts):
    """Every id in one piece, pieces of a sequence gapless, little padding; ``texts`` has distinct keys."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, text in texts.items():
        ids, at = ids_of(library, text), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            part = np.array(ids[at: at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at.bit_count() == 1


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.packed(docs, PATH).collect(), library, {r.doc_id: r.text for r in docs.collect()})


def test_defined_cases(spark, library, monkeypatch):
    texts = {1: None, 2: "", 3: "word " * 20_000, 4: "same text", 5: "same text", 6: "\n\n", None: "no key"}
    df = spark.createDataFrame([(t, k, "x", 0) for k, t in texts.items()], "text string, doc_id long, ids string, n int")
    check(packing.packed(df, PATH).collect(), library, texts)
    assert packing.packed(df.limit(0), PATH).count() == 0
    twice = packing.packed(df.union(df), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(ids_of(library, t)) for t in texts.values())


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, rng.integers(3, 12)) for _ in range(40)]
    idf = rng.random(60) + 0.1
    mean = float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean)
    used = rng.random(40) < 0.3
    used[0] = True

    def score(d):
        total = 0.0
        for t in set(docs[0].tolist()) & set(d.tolist()):
            tf = int((d == t).sum())
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        return total

    want = sorted((i for i in range(40) if not used[i]), key=lambda i: -score(docs[i]))
    assert list(shard.neighbours(0, used)) == want


def test_all_terms_of_a_long_seed_count():
    rng = np.random.default_rng(2)
    # the rarest 30 tokens of the seed are in no other document
    seed = np.concatenate([np.arange(30), rng.permutation(np.arange(40, 400))])
    docs = [seed, *(rng.choice(np.arange(40, 800), rng.integers(20, 300)) for _ in range(60))]
    idf = np.concatenate([np.full(30, 9.0), rng.random(770) + 0.1])
    mean = float(np.mean([len(d) for d in docs]))
    shard, used = packing.Shard(docs, idf, mean), np.zeros(61, bool)
    used[0] = True

    def score(d):
        has, tf = np.unique(d, return_counts=True)
        weight = idf[has] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        return weight[np.isin(has, seed)].sum()

    # also when used documents have left the table
    for _ in range(6):
        want = sorted((i for i in range(61) if not used[i]), key=lambda i: -score(docs[i]))
        assert list(shard.neighbours(0, used)) == want
        used[want[: len(want) // 2]] = True
    used[:] = True
    assert list(shard.neighbours(0, used)) == []


def slow_windows(docs, idf, mean):
    """The greedy packer by its definition: the best unused neighbour of the seed next, what is cut off is the next seed."""
    def score(a, b):
        total = 0.0
        for t in sorted(set(a.tolist()) & set(b.tolist())):
            tf = int((b == t).sum())
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(b) / mean))
        return round(total, 9)

    unused, out, window, room, seed = set(range(len(docs))), [], [], packing.WINDOW, None
    while unused or seed:
        if seed is None:
            seed = min(unused), 0
        doc, start = seed
        unused.discard(doc)
        queue = [seed, *((d, 0) for d in sorted(unused, key=lambda d: (-score(docs[doc], docs[d]), d)))]
        seed = None
        for d, s in queue:
            unused.discard(d)
            n = min(room, len(docs[d]) - s)
            window.append((d, s, n))
            room -= n
            if not room:
                out.append(window)
                window, room = [], packing.WINDOW
                seed = (d, s + n) if s + n < len(docs[d]) else None
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_equal_a_slow_greedy_packer(monkeypatch, seed):
    monkeypatch.setattr(packing, "WINDOW", 64)
    monkeypatch.setattr(packing, "FEW", 5)
    rng = np.random.default_rng(seed)
    # a term of all documents, frequent and rare ones; short documents, some longer than a window
    docs = [np.append(np.minimum(rng.geometric(0.02 * seed, rng.choice([0, 3, 20, 30, 200])), 398), 399) for _ in range(90)]
    idf = rng.random(400) + 0.05
    mean = float(np.mean([len(d) for d in docs]))
    want = slow_windows(docs, idf, mean)
    got = list(packing.Shard(docs, idf, mean).windows())
    assert len(want) > 20 and got[: len(want)] == want
    # the rest fills no window
    assert sum(n for w in got[len(want):] for _, _, n in w) < 64
