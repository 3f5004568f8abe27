"""Language identification by prediction by partial matching.

Per language, variable-order byte contexts: the bytes seen after each context
of 0 to ``ORDER`` bytes, with counts that stay frozen after training. The code
length of a byte is that of its longest known context; where the byte is new
there, the escape's length is added and the next shorter context is asked,
down to eight bits for a byte never seen. A text's language is the one whose
model codes the whole text in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, filled

#: Bytes of the longest context; a gram (context and byte) must fit in 63 bits.
ORDER = 4
#: About so many labelled rows of each language are learned from, whole texts, chosen by a hash of the key.
SAMPLE_ROWS = 1000
#: Bytes of text scored at a time, and grams whose code lengths a task remembers.
BYTES_AT_ONCE, REMEMBERED = 4 << 20, 2_000_000
UNKNOWN = "und"


def _grams(raw: np.ndarray, offs: np.ndarray, at: int, to: int) -> np.ndarray:
    """For positions at..to-1 the byte and the ORDER bytes before it in its text (zero before the start)."""
    out = np.zeros(to - at, np.int64)
    first = np.searchsorted(offs, at, "right") - 1
    starts = offs[first: np.searchsorted(offs, to, "left")]
    for back in range(ORDER, -1, -1):
        out <<= 8
        lead = max(0, back - at)
        if lead >= to - at:
            continue
        prev = raw[at - back + lead: to - back].astype(np.int64)
        if back:
            # bytes that belong to the text before
            i = (starts[:, None] + np.arange(back)).ravel() - at
            i = i[(i >= lead) & (i < to - at)] - lead
            prev[i] = 0
        out[lead:] |= prev
    return out


@dataclass(frozen=True)
class Model:
    """Per language and order: sorted contexts with escape lengths, sorted grams with code lengths (bits)."""

    languages: tuple[str, ...]
    contexts: tuple[tuple[tuple[np.ndarray, np.ndarray], ...], ...]
    grams: tuple[tuple[tuple[np.ndarray, np.ndarray], ...], ...]

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after its context, a row per language."""
        out = np.full((len(self.languages), len(grams)), 8.0)
        for bits, contexts, known in zip(out, self.contexts, self.grams, strict=True):
            for k in range(ORDER + 1):
                hit, value = _find(*known[k], grams & ((1 << 8 * (k + 1)) - 1))
                seen, escape = _find(*contexts[k], (grams >> 8) & ((1 << 8 * k) - 1))
                bits[:] = np.where(hit, value, np.where(seen, bits + escape, bits))
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[i] == wanted, values[i]


def _model(counts: pd.DataFrame) -> Model:
    """From the counts of the longest grams; those of shorter contexts are their sums."""
    languages = tuple(sorted(counts["lang"].unique(), key=lambda x: x.encode()))
    contexts, grams = [], []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        full, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
        by_context, by_gram = [], []
        for k in range(ORDER + 1):
            keys, where = np.unique(full & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.bincount(where, n)
            ctx, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.bincount(of, seen), np.bincount(of)
            by_gram.append((keys, np.log2((total + distinct)[of] / seen)))
            by_context.append((ctx, np.log2((total + distinct) / distinct)))
        contexts.append(tuple(by_context))
        grams.append(tuple(by_gram))
    return Model(languages, tuple(contexts), tuple(grams))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column(1).to_numpy(zero_copy_only=False)
        for lang in set(langs):
            raw, offs = bytes_of(b.column(0).filter(pa.array(langs == lang)))
            for at in range(0, len(raw), BYTES_AT_ONCE):
                grams, n = np.unique(_grams(raw, offs, at, min(at + BYTES_AT_ONCE, len(raw))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def held_out(key: str) -> Column:
    """crc32 of the key as text is divisible by five; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """A model from about ``rows`` labelled rows of each language that are not held out.

    Rows without text, language or key teach nothing. Only the counts of the
    sample's grams reach the driver; the sample, and so the model, does not
    grow with the table.
    """
    labelled = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("k"), held_out(key).alias("out"))
    labelled = labelled.filter("t IS NOT NULL AND lang IS NOT NULL AND k IS NOT NULL AND NOT out").select("t", "lang", "k")
    share = {r["lang"]: min(1.0, rows / r["count"]) for r in labelled.drop("t").groupBy("lang").count().collect()}
    if not share:
        return Model((), (), ())
    draw = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = labelled.filter(draw < F.element_at(limit, F.col("lang"))).select("t", "lang")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _model(counts.toPandas())


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.bits = model, pd.Index([], dtype=np.int64), np.zeros((len(model.languages), 0))

    def totals(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text, a row per language."""
        out = np.zeros((len(self.model.languages), len(offs) - 1))
        for at in range(0, len(raw), BYTES_AT_ONCE):
            to = min(at + BYTES_AT_ONCE, len(raw))
            codes, found = pd.factorize(_grams(raw, offs, at, to))
            where = self.known.get_indexer(found)
            new = found[where < 0]
            if len(new):
                if len(self.known) + len(new) > REMEMBERED:
                    self.known, self.bits = pd.Index([], dtype=np.int64), self.bits[:, :0]
                    new = found
                self.known = self.known.append(pd.Index(new))
                self.bits = np.concatenate([self.bits, self.model.lengths(new)], axis=1)
                where = self.known.get_indexer(found)
            first = np.searchsorted(offs, at, "right") - 1
            last = np.searchsorted(offs, to, "left")
            texts = np.arange(first, last)[np.diff(offs[first: last + 1]) > 0]
            cuts = np.maximum(offs[texts], at) - at
            for bits, total in zip(self.bits, out, strict=True):
                total[texts] += np.add.reduceat(bits[where][codes], cuts)
        return out


def _predict(shared, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model)
        names = np.array([*model.languages, UNKNOWN], object)
        for b in batches:
            raw, offs = bytes_of(filled(b.column(0)))
            letter = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(b.num_rows, len(model.languages)), np.zeros(b.num_rows)
            if model.languages and b.num_rows:
                bits = scorer.totals(raw, offs)
                best = np.where(letter, bits.argmin(axis=0), best)
                score = np.where(letter, 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(names[best], pa.string()), pa.array(score), *b.columns[2:]], fields)

    return run


def predict(df: DataFrame, model: Model, text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """lang_pred and score for every row of ``df``, after the named columns of ``carry``.

    The whole text is read, however long. Null, empty texts and texts without
    a letter are ``und`` with score 0, as is everything under a model that has
    learned no language. Ties go to the language first in byte order. score is
    the posterior of the prediction under equal priors. Rows are treated one by
    one: repeated rows get the same answer, an empty table gives no rows.
    """
    carry = carry or {}
    cols = df.select(
        F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
        *[c.alias(n) for n, c in carry.items()])
    shape = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *cols.schema.fields[2:]])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return cols.mapInArrow(_predict(shared, shape.names), shape).select(*carry, "lang_pred", "score")


def known_language(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language the model names with a score of ``least`` or more."""
    row = {"row": F.struct(*[F.col(f"`{c}`") for c in df.columns])}
    named = predict(df, model, text, row)
    return named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
