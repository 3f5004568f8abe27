"""Chat formatting with a template that is a black box.

A template turns a list of turns into text. The formatter renders successive
prefixes of a conversation and compares neighbouring outputs: what a turn adds
is its span, and where an earlier part of the output changed, the template
rewrites history. A turn's own text is found in its span by rendering the
prefix twice with probe texts: what both have in common is the template's.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Turns of an output row; also the longest prefix rendered for a template of bounded context.
SEGMENT = 16
PROBES = ("a", "b")
#: Segments that the check of a declared context looks back at most.
REACH = 64

Turn = tuple[str, str]


@dataclass(frozen=True)
class Template:
    """``render`` as a black box over (role, text) turns.

    ``context`` is the number of earlier turns that what a turn adds may
    depend on; None says any number, and that history may be rewritten.
    """

    render: Callable[[Sequence[Turn]], str]
    context: int | None = None
    learn_from: str = "assistant"


@dataclass(frozen=True)
class Span:
    """A turn's place in a segment's text, and its text's place if it is learned from (else -1)."""

    start: int
    end: int
    loss_start: int
    loss_end: int


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


class Formatter:
    """Takes the turns of one conversation in; gives segments (text, spans, turns that rewrote history)."""

    def __init__(self, template: Template, segment: int = SEGMENT):
        self.template, self.segment = template, segment
        self.window: list[Turn] = []
        self.past: deque[Turn] = deque(maxlen=segment * REACH)
        self.cuts = 0
        self.before, self.spans, self.text, self.size, self.rewrites = "", [], [], 0, 0

    def add(self, role: str, text: str) -> Iterator[tuple[str, list[Span], int]]:
        t, render = self.template, self.template.render
        after = render([*self.window, (role, text)])
        same = len(self.before) if after.startswith(self.before) else _common(self.before, after)
        if same < len(self.before):
            if t.context is not None:
                raise ValueError("the template rewrites history; declare it with context=None")
            self.rewrites += 1
        added, loss = after[same:], (-1, -1)
        if role == t.learn_from and not self.rewrites:
            one, two = (render([*self.window, (role, p)]) for p in PROBES)
            head = _common(one, two)
            loss = head - same, len(after) - (len(one) - head - len(PROBES[0])) - same
        at = self.size
        self.spans.append(Span(at, at + len(added), *(at + x if x >= 0 else -1 for x in loss)))
        self.text.append(added)
        self.size += len(added)
        self.window.append((role, text))
        self.before = after
        if t.context is not None:
            self.past.append((role, text))
        if t.context is not None and len(self.spans) >= self.segment:
            self.check()
            yield self.cut()
            self.window = self.window[len(self.window) - t.context:]
            self.before = render(self.window) if self.window else ""

    def check(self) -> None:
        """Raises if the segment reads otherwise behind earlier turns, or changes them.

        The first cut looks one segment back, every second one two, every
        fourth one four, up to REACH: linear in the turns but for that factor's
        logarithm, and only the last turns are held.
        """
        self.cuts += 1
        n = min(self.segment * (1 + (self.cuts & -self.cuts)), len(self.past))
        if n <= self.segment:
            return
        turns = list(self.past)[len(self.past) - n:]
        before = self.template.render(turns[: n - self.segment])
        if self.template.render(turns) != before + "".join(self.text):
            raise ValueError("the template looks further back than its declared context")

    def cut(self) -> tuple[str, list[Span], int]:
        out = ("".join(self.text), self.spans, 0) if not self.rewrites else (self.before, [], self.rewrites)
        self.spans, self.text, self.size = [], [], 0
        return out

    def end(self) -> Iterator[tuple[str, list[Span], int]]:
        if self.spans:
            yield self.cut()


def _format(template: Template, segment: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, key, formatter = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            rows = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if formatter is None or conv != key:
                    rows += [(key, s) for s in formatter.end()] if formatter else []
                    key, formatter = conv, Formatter(template, segment)
                rows += [(conv, s) for s in formatter.add(role, text)]
            if rows:
                yield _segments(rows, part, number, out)
                number += len(rows)
        if formatter and (rows := [(key, s) for s in formatter.end()]):
            yield _segments(rows, part, number, out)

    return run


def _segments(rows: list, part: int, number: int, out: pa.Schema) -> pa.RecordBatch:
    spans = [[vars(x) for x in s[1]] for _, s in rows]
    cols = [[k for k, _ in rows], [part] * len(rows), range(number, number + len(rows)), [s[0] for _, s in rows], spans, [s[2] for _, s in rows]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)


def formatted(
    df: DataFrame, template: Template, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT,
) -> DataFrame:
    """Segments of formatted text: conversation, part, seg, formatted, spans, rewrites.

    Turns go by ``turn``, then role, then text, nulls first; repeated rows are
    repeated turns. Null role and text are empty; rows without a conversation
    are one conversation. Segments of a conversation follow one another by
    (part, seg). A template of bounded context is rendered over at most
    ``segment`` turns and its context, and checked against renderings that reach
    up to REACH segments further back; what differs raises. If it needs no context, a conversation
    may be cut anywhere and the turns of a long one are spread over tasks.
    With context=None a conversation is one segment, held whole; where the
    template rewrites history the text is that of the whole conversation,
    ``rewrites`` counts the turns that did, and there are no spans. An empty
    table gives no rows. Other columns are neither read nor renamed.
    """
    cols = df.select(
        F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    if template.context == 0:
        cols = cols.repartitionByRange("c", "n", "r", F.substring("t", 1, 64))
    else:
        cols = cols.repartition("c")
    cols = cols.sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "loss_start", "loss_end")])
    shape = T.StructType([
        T.StructField(conv, df.schema[conv].dataType), T.StructField("part", T.IntegerType()), T.StructField("seg", T.LongType()),
        T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(span)), T.StructField("rewrites", T.IntegerType())])
    return cols.mapInArrow(_format(template, segment, to_arrow_schema(shape)), shape)


# The instruction template: marks turns, and breaks its own control strings inside texts with a backslash.

CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>(.*?)(?:\[INST\](.*?)\[/INST\]|\[/INST\](.*?))</s>", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_instructions(turns: Sequence[Turn]) -> str:
    return "".join(
        f"<s>assistant[/INST]{escape(text)}</s>" if role == "assistant" else f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>"
        for role, text in turns)


INSTRUCTIONS = Template(render_instructions, context=0)


def parse_instructions(formatted: str) -> list[Turn]:
    """The turns of a formatted text; fails on text the template did not write."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])))
        at = m.end()
    return out


def _digest(parse, restore, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for b in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != key:
                    rows += [row()] if state else []
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["loss_start"] >= 0:
                        learned = restore(text[s["loss_start"]: s["loss_end"]])
                        state[2] += len(learned)
                        state[3].update(learned.encode())
                state[4] += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), out, strict=True)], schema=out)

    return run


def read_back(segments: DataFrame, conv: str = "conv_id", parse=parse_instructions, restore=unescape) -> DataFrame:
    """Per conversation what a reader finds in the formatted text: turns, loss text and sizes.

    A conversation's segments stream through one task in order, a segment at a
    time: a digest over all its turns has no parts that could be combined.
    """
    shape = T.StructType([
        T.StructField(conv, segments.schema[conv].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    ordered = segments.repartition(F.col(f"`{conv}`")).sortWithinPartitions(F.col(f"`{conv}`"), "part", "seg").select(F.col(f"`{conv}`"), "formatted", "spans")
    return ordered.mapInArrow(_digest(parse, restore, to_arrow_schema(shape)), shape)
