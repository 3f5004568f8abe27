"""Packing documents into fixed windows by lexical retrieval.

Documents become token ids once. Corpus-wide token statistics (document
frequencies over the tokenizer's vocabulary) feed BM25. Range partitioning on a
MinHash of the tokens deals documents into shards, alike ones together and
equal ones spread by their key. Each shard has an inverted index. BM25 over
all terms of a seed document, added up from their lists, ranks the unused others; they fill its window in order of score, and
what the window cuts off is the next seed. The rest of a shard that fills no
window is cut into powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import compress
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import SPACES, bytes_of, filled, stored, text_or_empty

#: Tokens of a window, and the id that ends each document.
WINDOW, END_ID = 4096, 2
#: Tokens indexed together; a single longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Neighbours put in order at once.
FEW = 256
#: Bytes of text tokenized at a time, and words a worker remembers.
BYTES_AT_ONCE, REMEMBERED = 2 << 20, 600_000

def _of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_MARK, _SPACE, _LETTER = _of(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)), _of(SPACES), _of(bytes(range(97, 123)))


#: ASCII marks but the apostrophe, which can begin a unit together with letters.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: The byte-level alphabet: visible Latin-1 characters name their own byte, the other bytes follow from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NAME_OF = np.arange(256, dtype="<u2")
_NAME_OF[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_NAME_OF[32] = 32  # blanks separate words here


def _names(data: bytes) -> str:
    """The byte-level names of some bytes."""
    return _NAME_OF[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le")


def _steady(letters: str) -> bool:
    """The normaliser leaves these letters as they are."""
    return letters.isascii() or (max(letters) < "\u0500" and is_normalized("NFC", letters) and letters.lower() == letters)


def _gaps(ids: list) -> list[int]:
    """The places of None."""
    out, at = [], -1
    try:
        while True:
            at = ids.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases.

    No token spans white space, so each word is encoded once and remembered.
    ``tests/llm`` hold the ids against the library's own over whole texts.
    """

    def __init__(self, path: str):
        # Spark runs a worker for each core: threads within one would only hold memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.token = [np.array(i, self.dtype).tobytes() for i in range(self.size)]
        self.words: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _unit(self, text: str) -> bytes:
        """The ids of one run of letters or of marks, straight from the merges."""
        if not text.isascii():
            text = _names(text.encode())
        token = self.token
        return b"".join([token[t.id] for t in self.tokenizer.model.tokenize(text)])

    def _learn(self, new: set[bytes]) -> None:
        """Remembers the ids of new words; all that are letters only go through the merges together."""
        keys = list(new)
        texts = b" ".join(keys).decode().split(" ") if keys else []
        plain = list(map(str.isalpha, texts))
        if not _steady(" ".join(compress(texts, plain))):
            plain = [p and _steady(s) for p, s in zip(plain, texts, strict=True)]
        units = list(compress(keys, plain))
        if units:
            names = _names(b" ".join(units)).split(" ")
            tokens = list(map(self.tokenizer.model.tokenize, names))
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            data = np.fromiter((t.id for x in tokens for t in x), self.dtype, int(ends[-1])).tobytes()
            ends = (ends * self.dtype.itemsize).tolist()
            self.words.update((w, data[s:e]) for w, s, e in zip(units, [0, *ends[:-1]], ends, strict=True))
        other = []
        for w, s, p in zip(keys, texts, plain, strict=True):
            if p:
                continue
            core = s.strip(_MARKS)
            if core and not (core.isalpha() and _steady(core)):
                other.append((w, s))
                continue
            # marks, or letters between marks: each run is a unit
            at = s.index(core) if core else len(s)
            self.words[w] = b"".join(self._unit(x) for x in (s[:at], core, s[at + len(core):]) if x)
        if other:
            found = self.tokenizer.encode_batch_fast([s for _, s in other], add_special_tokens=False)
            self.words.update((w, np.array(e.ids, self.dtype).tobytes()) for (w, _), e in zip(other, found, strict=True))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The ids of each text raw[offs[i]:offs[i + 1]], as little-endian integers of ``dtype``."""
        data = raw[offs[0]: offs[-1]].tobytes()
        low, at = _separated(_lowered(data, offs - offs[0]), offs - offs[0])
        split = [low[s:e].split() for s, e in zip(at[:-1], at[1:], strict=True)]
        found = [list(map(self.words.get, words)) for words in split]
        gaps = [_gaps(ids) for ids in found]
        new = {words[i] for words, at in zip(split, gaps, strict=True) for i in at}
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
        self._learn(new)
        for words, ids, at in zip(split, found, gaps, strict=True):
            for i in at:
                ids[i] = self.words[words[i]]
        out = [b"".join(ids) for ids in found]
        if b"<|" in data:
            # a special token's name counts as that token only in its own case
            for i, (s, e) in enumerate(zip((offs[:-1] - offs[0]).tolist(), (offs[1:] - offs[0]).tolist(), strict=True)):
                if b"<|" in data[s:e]:
                    out[i] = self._ids(data[s:e].decode())
        return out


def _lowered(data: bytes, offs: np.ndarray) -> bytes:
    """Lower case where it is sure to keep a text's length and to agree with the normaliser, else A-Z only.

    That is in texts without a character from U+0180 on, or U+0130.
    """
    x = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(np.diff(offs) > 0)
    largest = np.maximum.reduceat(x, offs[full]) if len(full) else x
    out, at = [], 0
    for i in full[(largest > 127) & (largest < 0xC6)].tolist():
        s, e = int(offs[i]), int(offs[i + 1])
        if b"\xc4\xb0" not in data[s:e]:
            out += [data[at:s].lower(), data[s:e].decode().lower().encode()]
            at = e
    return b"".join([*out, data[at:].lower()])


def _separated(low: bytes, offs: np.ndarray) -> tuple[bytes, list[int]]:
    """A space between a letter and up to four marks that end a word, and the new offsets.

    The marks are a unit of their own there, and the word before them needs
    remembering only once.
    """
    x = np.frombuffer(low, np.uint8)
    if len(x) < 2:
        return low, offs.tolist()
    mark = _MARK[x]
    stop = np.zeros(len(x), bool)
    stop[:-1] = _SPACE[x[1:]]
    stop[offs[1:][np.diff(offs) > 0] - 1] = True
    ends = run = mark & stop
    for _ in range(3):
        before = np.zeros(len(x), bool)
        before[:-1] = run[1:]
        run = before & mark & ~stop
        ends = ends | run
    letter = _LETTER[x]
    # the letters from U+00C0 to U+017F, by their two bytes; U+0130 ends in a mark when lower-cased
    second = np.zeros(len(x), bool)
    first, then = x[:-1], x[1:]
    no_letter = ((first == 0xC3) & ((then == 0x97) | (then == 0xB7))) | ((first == 0xC4) & (then == 0xB0))
    second[1:] = (first >= 0xC3) & (first < 0xC6) & ~no_letter
    letter |= second
    ends[1:] &= letter[:-1]
    ends[0] = False
    cuts = np.flatnonzero(ends)
    return np.insert(x, cuts, 32).tobytes(), (offs + np.searchsorted(cuts, offs)).tolist()


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _hashes(ids: np.ndarray) -> tuple[int, int]:
    """Two MinHashes over the tokens."""
    x = ids.astype(np.uint64)
    out = []
    for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        y = (x + np.uint64(1)) * np.uint64(mult)
        out.append(int(((y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).min()))
    return out[0], out[1]


def _tokenize(path: str, end_id: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        end = np.array([end_id], tok.dtype).tobytes()
        for b in batches:
            raw, offs = bytes_of(filled(b.column(0)))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + BYTES_AT_ONCE, "right")) - 1)
                ids = [x + end for x in tok.encode(raw, offs[at: to + 1])]
                marks = [_hashes(np.frombuffer(x, tok.dtype)) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.binary()), pa.array([len(x) // tok.dtype.itemsize for x in ids], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), *(c.slice(at, to - at) for c in b.columns[1:])], fields)
                at = to

    return run


def tokenized(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """ids (little-endian integers, the end id last), n, two MinHashes, a checksum and the key ``k``, stored."""
    cols = df.select(text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k"))
    shape = T.StructType([
        T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n", "m1", "m2", "sum")), T.StructField("k", df.schema[key].dataType)])
    return stored(cols.mapInArrow(_tokenize(tokenizer, end_id, shape.names), shape))


def _frequencies(dtype: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for b in batches:
            raw, offs = bytes_of(b.column(0))
            ids = np.frombuffer(raw.tobytes(), dtype)
            for s, e in zip((offs[:-1] // dtype.itemsize).tolist(), (offs[1:] // dtype.itemsize).tolist(), strict=True):
                has = np.zeros(size, bool)
                has[ids[s:e]] = True
                found += has
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["token", "n"])

    return run


class Shard:
    """A BM25 inverted index of some documents, and the windows they fill."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.terms = docs, len(idf)
        sizes = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        pairs, tf = np.unique(owner * len(idf) + np.concatenate(docs), return_counts=True)
        doc, self.term = pairs // len(idf), pairs % len(idf)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
        self._index(np.arange(len(docs)), slice(None))

    def _index(self, left: np.ndarray, rows: slice | np.ndarray) -> None:
        """Postings by term of the documents ``left``, whose pairs are ``rows``; documents go by their place in ``left``.

        A term that a quarter of them have has its list as an array over all of them.
        """
        self.left = left
        doc = np.repeat(np.arange(len(left)), self.bounds[left + 1] - self.bounds[left])
        term, weight = self.term[rows], self.weight[rows]
        size = np.bincount(term, minlength=self.terms)
        often = 4 * size >= max(len(left), 1)
        self.place = np.cumsum(often) - 1
        self.place[~often] = -1
        common = often[term]
        self.lists = np.zeros((int(np.count_nonzero(often)), len(left)))
        self.lists[self.place[term[common]], doc[common]] = weight[common]
        term, doc, weight = term[~common], doc[~common], weight[~common]
        order = np.argsort(term.astype(np.uint16 if self.terms <= 1 << 16 else np.int64), kind="stable")
        self.posted, self.posted_weight = doc[order], weight[order]
        self.ends = np.cumsum(np.where(often, 0, size))

    def _unused(self, used: np.ndarray) -> None:
        """Drops the postings of used documents whenever they are half of the rest."""
        stay = ~used[self.left]
        if 2 * np.count_nonzero(stay) > len(stay):
            return
        left = self.left[stay]
        sizes = self.bounds[left + 1] - self.bounds[left]
        starts = np.cumsum(sizes) - sizes
        self._index(left, np.arange(int(sizes.sum())) + np.repeat(self.bounds[left] - starts, sizes))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the documents ``left`` for all terms of the seed: the lists of its terms are added up, no others are looked at."""
        terms = self.term[self.bounds[seed]: self.bounds[seed + 1]]
        at = self.place[terms]
        asked = np.zeros(len(self.lists))
        asked[at[at >= 0]] = 1.0
        score = asked @ self.lists
        rare = terms[at < 0]
        ends = self.ends[rare]
        sizes = ends - np.where(rare > 0, self.ends[rare - 1], 0)
        rows = np.arange(int(sizes.sum())) + np.repeat(ends - np.cumsum(sizes), sizes)
        return score + np.bincount(self.posted[rows], self.posted_weight[rows], len(self.left))

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents, best BM25 score over all terms of the seed first; those that share none come last, in order."""
        self._unused(used)
        free = np.flatnonzero(~used[self.left])
        if not len(free):
            return
        score = self.scores(seed)[free]
        # a window seldom takes more; all others follow in order if it does
        least = np.partition(score, len(score) - FEW)[len(score) - FEW] if len(score) > FEW else -np.inf
        for some in (np.flatnonzero(score >= least), np.flatnonzero(score < least)):
            yield from self.left[free[some]][np.argsort(-score[some], kind="stable")].tolist()

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, length)."""
        used = np.zeros(len(self.docs), bool)
        window: list[tuple[int, int, int]] = []
        room, first = WINDOW, 0
        rest: tuple[int, int] | None = None
        while True:
            if rest is None:
                while first < len(used) and used[first]:
                    first += 1
                if first == len(used):
                    break
                used[first] = True
                rest = first, 0
            fill, rest = self._chain(rest, used), None
            for doc, start in fill:
                used[doc] = True
                n = min(room, len(self.docs[doc]) - start)
                window.append((doc, start, n))
                room -= n
                if not room:
                    yield window
                    window, room = [], WINDOW
                    if start + n < len(self.docs[doc]):
                        rest = doc, start + n
                    break
            else:
                break
        yield from _powers(window, WINDOW - room)

    def _chain(self, seed: tuple[int, int], used: np.ndarray) -> Iterator[tuple[int, int]]:
        yield seed
        for doc in self.neighbours(seed[0], used):
            yield doc, 0


def _powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into sequences of distinct powers of two, the largest first."""
    queue = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, out = total & (1 << bit), []
        while room:
            doc, start, n = queue.pop()
            take = min(n, room)
            out.append((doc, start, take))
            if take < n:
                queue.append((doc, start + take, n - take))
            room -= take
        if out:
            yield out


def _pack(dtype: np.dtype, shared, mean: float, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, sequence = shared.value, TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        docs: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in Shard(docs, idf, mean).windows():
                at = 0
                for doc, start, n in window:
                    ids = docs[doc][start: start + n].astype("<u4")
                    rows.append((doc, start, n, zlib.crc32(ids), len(docs[doc]), sequence, at))
                    at += n
                sequence += 1
            cols = np.array(rows, np.int64).T
            k = pa.concat_arrays(keys).take(pa.array(cols[0]))
            return pa.RecordBatch.from_arrays([k, *map(pa.array, cols[1:])], fields)

        for b in batches:
            raw, offs = bytes_of(b.column(0))
            at = 0
            while at < b.num_rows:
                left = SHARD_TOKENS * dtype.itemsize - size
                to = max(at + (not docs), int(np.searchsorted(offs, offs[at] + left, "right")) - 1)
                ids = raw[offs[at]: offs[to]].view(dtype)
                docs += np.split(ids, (offs[at + 1: to] - offs[at]) // dtype.itemsize) if to > at else []
                keys.append(b.column(1).slice(at, to - at))
                size += int(offs[to] - offs[at])
                at = to
                if at < b.num_rows:
                    yield shard()
                    keys, docs, size = [], [], 0
        if docs:
            yield shard()

    return run


def packed(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null counts as the empty text, whose only token is the end id. Each id of
    each row lies in one piece; rows that repeat are packed as often as they
    occur. A document longer than a window goes on in the next one. An empty
    table gives no rows. Other columns are neither read nor renamed.
    """
    ids = tokenized(df, tokenizer, text, key, end_id)
    tok = loaded(tokenizer)
    sums = ids.agg(F.count("*"), F.sum("n")).first()
    mean = (sums[1] or 1) / max(1, sums[0])
    # one row per token of the vocabulary at most
    seen = ids.select("ids").mapInArrow(_frequencies(tok.dtype, tok.size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    df_of = np.zeros(tok.size)
    df_of[seen["token"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
    idf = np.log1p((sums[0] - df_of + 0.5) / (df_of + 0.5))
    shape = T.StructType([
        T.StructField(key, ids.schema["k"].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    order = [F.col(c) for c in ("m1", "m2", "sum", "k")]
    dealt = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("ids", "k")
    shared = df.sparkSession.sparkContext.broadcast(idf)
    return dealt.mapInArrow(_pack(tok.dtype, shared, mean, shape.names), shape)
