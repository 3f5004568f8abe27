"""Secrets in text: known forms, and strings that stay incompressible where secrets are named.

The known forms are patterns over the whole text. The second pass looks at
token-like strings that follow a word such as ``key`` or ``bearer``: zstandard,
primed with a dictionary of identifiers, compresses the surrounding text with
and without the string, and the bytes it adds say how new it is. Words,
paths and identifiers of the surroundings add few; random keys add most of
their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, filled, text_or_empty

# fixed values: the forms asked for
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words of a sensitive context, and the bytes after one in which a candidate may begin.
CONTEXT = re.compile(rb"passw|passphrase|secret|token|api_?key|apikey|private_?key|access_?key|bearer|credential|signature|authorization", re.IGNORECASE)
REACH = 48
LEAST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Surrounding bytes on each side that the candidate is measured against.
AROUND = 512
#: Added bytes for each byte of the candidate from which it counts as new.
NOVEL = 0.6
#: What code around secrets is made of.
IDENTIFIERS = (
    "password", "passwd", "passphrase", "secret", "token", "api_key", "apiKey", "access_key", "private_key", "credential", "bearer",
    "authorization", "signature", "client_id", "client_secret", "username", "example", "placeholder", "changeme", "your_key_here",
    "undefined", "null", "None", "true", "false", "function", "return", "import", "const", "static", "public", "private", "string",
    "config", "settings", "environment", "os.environ", "process.env", "getenv", "https://", "http://", "localhost", "www.", ".com/",
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "00000000", "xxxxxxxxxxxxxxxx", "----------------",
    "================", "________________", "connection", "database", "endpoint", "resource", "container", "application", "repository",
)

_HINTS = (b"passw", b"secret", b"token", b"api")
_CONTEXT_HINTS = (b"passphrase", b"key", b"bearer", b"credential", b"signature", b"authorization")


def _places(string: bytes, text: bytes) -> Iterator[tuple[int, int]]:
    """Where ``text`` holds the string, or what it gives a value: a part between equal signs that could be a candidate itself.

    From the left, the longest of those that begin at a place, without overlap. All parts are looked for together, by their first bytes.
    """
    parts = {p for p in string.split(b"=") if p != string and CANDIDATE.fullmatch(p)}
    if not parts:
        at = text.find(string)
        while at >= 0:
            yield at, at + len(string)
            at = text.find(string, at + len(string))
        return
    heads: dict[bytes, list[bytes]] = {}
    for p in sorted({string, *parts}, key=len, reverse=True):
        heads.setdefault(p[:LEAST], []).append(p)
    at = 0
    while at + LEAST <= len(text):
        found = next((p for p in heads.get(text[at: at + LEAST], ()) if text.startswith(p, at)), None)
        if found:
            yield at, at + len(found)
        at += len(found) if found else 1


def _without(text: bytes, lo: int, hi: int, low: int, high: int, string: bytes) -> bytes:
    """text[lo:hi] less the copies in text[low:high], also of those that reach over its ends."""
    out, at = [], lo
    for s, e in _places(string, text[low:high]):
        out.append(text[at: min(hi, max(at, low + s))])
        at = max(at, low + e)
    return b"".join([*out, text[at:hi]])


class Scanner:
    def __init__(self, novel: float = NOVEL):
        dictionary = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor, self.novel = zstandard.ZstdCompressor(level=9, dict_data=dictionary), novel

    def novelty(self, text: bytes, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, for each of its bytes.

        Other copies of the string there do not count, else a repeated secret would be known at each of its places.
        """
        string = text[start:end]
        n = end - start
        before = _without(text, max(0, start - AROUND), start, max(0, start - AROUND - n + 1), start, string)
        after = _without(text, end, min(len(text), end + AROUND), end, end + AROUND + n - 1, string)
        size = lambda x: len(self.compressor.compress(x))
        # in place, and last, where it can refer to all of the surroundings; the smaller one, as tables shift by some bytes
        rest = before + after
        return (min(size(before + string + after), size(rest + string)) - size(rest)) / (end - start)

    def spans(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, novelty) in bytes, by start and kind; novelty is 0 for the known forms."""
        out: list[tuple[int, int, int, float]] = []
        low = text.lower()
        hinted = any(h in low for h in _HINTS)
        if hinted:
            out += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if b"AKIA" in text:
            out += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        out += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
        if hinted or any(h in low for h in _CONTEXT_HINTS):
            out += self._new(text, sorted(out))
        return sorted(out)

    def _new(self, text: bytes, known: list[tuple[int, int, int, float]]) -> Iterator[tuple[int, int, int, float]]:
        """Context words and token-like runs, both from left to right and each once.

        What follows a context word inside its own run is a candidate too.
        """
        taken, done, k = 0, 0, 0
        runs = CANDIDATE.finditer(text)
        run = next(runs, None)
        for m in CONTEXT.finditer(text):
            at = max(m.end(), done)
            while run and run.end() - at < LEAST:
                run = next(runs, None)
            while run and (s := max(run.start(), at)) <= m.end() + REACH:
                e = done = run.end()
                while k < len(known) and known[k][0] < e:
                    taken, k = max(taken, known[k][2]), k + 1
                if s >= taken and (value := self.novelty(text, s, e)) >= self.novel:
                    yield s, 3, e, value
                run = next(runs, None)


def _points(text: bytes, cuts: list[int]) -> dict[int, int]:
    """Code points before each byte position."""
    if text.isascii():
        return {c: c for c in cuts}
    out, at, n = {}, 0, 0
    data = np.frombuffer(text, np.uint8)
    for c in sorted(cuts):
        n += int(np.count_nonzero((data[at:c] & 0xC0) != 0x80))
        out[c], at = n, c
    return out


def _scan(novel: float, spans_type: pa.DataType, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novel)
        for b in batches:
            raw, offs = bytes_of(filled(b.column(0)))
            found = []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text = raw[s:e].tobytes()
                spans = scanner.spans(text)
                point = _points(text, [x for sp in spans for x in (sp[0], sp[2])]) if spans else {}
                found.append([{"kind": KINDS[k], "start": point[a], "end": point[z], "novelty": v} for a, k, z, v in spans])
            yield pa.RecordBatch.from_arrays([pa.array(found, spans_type), *b.columns[1:]], fields)

    return run


def secret_spans(df: DataFrame, text: str = "text", key: str = "doc_id", novel: float = NOVEL) -> DataFrame:
    """key and ``spans`` of every row: kind, start, end (code points, end exclusive) and novelty, by start, then kind.

    Kinds are ``assign``, ``access`` and ``hex`` for the known forms, leftmost
    and without overlap inside a kind, and ``novel`` for strings that only the
    compression test finds; these overlap no other span. Null counts as the
    empty text and has no spans. Rows are treated one by one, repeated rows
    and rows without a key included; an empty table gives no rows. Other
    columns are neither read nor renamed.
    """
    span = T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
    shape = T.StructType([T.StructField("spans", span), T.StructField("k", df.schema[key].dataType)])
    cols = df.select(text_or_empty(text).alias("t"), F.col(f"`{key}`").alias("k"))
    return cols.mapInArrow(_scan(novel, kind, shape.names), shape).select(F.col("k").alias(key), "spans")


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts of the known forms, a digest of their places, and all places as text."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda x: F.array_join(F.transform(x, place), ",")
    known = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        *[c for c in spans.columns if c != "spans"], *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(known), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
