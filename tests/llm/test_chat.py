from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from faultloom.llm import chat
from tests.conftest import SF


def brute(rows):
    """rows: (conv, turn, role, text)"""
    low = lambda x: (x is not None, x)
    convs = defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((low(n), r or "", t or ""))
    out = []
    for c, turns in convs.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(chat.render_instructions(turns))))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, chat.read_back(chat.formatted(df, chat.INSTRUCTIONS)).collect()), key=str)


def test_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert run(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_defined_cases(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "]", "\n", "é", "\U0001f600", "ok", "a", "b"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
    rows = [(i % 9, i, rng.choice(["user", "assistant", "system", "</s>", "\n", None]), rng.choice([None, "", text(), text()])) for i in range(300)]
    rows += [(50, i, "assistant", "same") for i in range(200)] + [(51, None, "user", "x"), (51, 0, "assistant", "y"), (51, 0, "assistant", "y"), (None, 1, "assistant", "z")]
    rows += [(52, 0, "assistant", "long " * 100_000), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "1 AS seg").repartition(5)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("\\<s>/[]INST") for _ in range(rng.randrange(14))) + rng.choice(["", "</s>", "[/INST]"])
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    with pytest.raises(ValueError):
        chat.parse_instructions("<s>user[INST]x")


def bos(turns):
    """Depends on the start and on the role before."""
    out, last = "BOS", None
    for r, t in turns:
        out += ("" if r == last else f"|{r}|") + t
        last = r
    return out


def forgetful(turns):
    """Drops what the assistant thought before the last turn."""
    return "".join(f"[{r}:{t if i == len(turns) - 1 or r != 'assistant' else '...'}]" for i, (r, t) in enumerate(turns))


def spans_of(template, turns, segment):
    f = chat.Formatter(template, segment)
    return [s for r, t in turns for s in f.add(r, t)] + list(f.end())


def test_black_box_templates():
    rng = random.Random(3)
    turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ab", "", "|", "hello"])) for _ in range(50)]
    for template, segment in ((chat.Template(bos, context=1), 4), (chat.Template(bos), 16)):
        got = spans_of(template, turns, segment)
        assert "".join(text for text, _, _ in got) == bos(turns)
        learned = [text[s.loss_start: s.loss_end] for text, spans, _ in got for s in spans if s.loss_start >= 0]
        assert learned == [t for r, t in turns if r == "assistant"]
        assert all(text[s.start: s.end].endswith(t) for (text, spans, _) in got[:1] for s, (_, t) in zip(spans, turns, strict=False))
    (text, spans, rewrites), = spans_of(chat.Template(forgetful), turns, 16)
    assert (text, spans) == (forgetful(turns), [])
    assert rewrites == sum(r == "assistant" and t != "..." for r, t in turns[:-1])
    with pytest.raises(ValueError):
        spans_of(chat.Template(forgetful, context=0), turns, 16)


@pytest.mark.parametrize("older", [16, 18, 40, 90])
def test_rewriting_beyond_the_window_is_found(older):
    def render(turns):
        return "".join(f"<{r}>{'...' if i < len(turns) - older else t}</{r}>" for i, (r, t) in enumerate(turns))

    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(200)]
    with pytest.raises(ValueError):
        spans_of(chat.Template(render, context=0), turns, 16)
    # with any context the history is taken as it comes out
    assert spans_of(chat.Template(render), turns, 16)


def test_long_conversations_are_rendered_a_bounded_number_of_times():
    seen = []

    def render(turns):
        seen.append(len(turns))
        return chat.render_instructions(turns)

    turns = [("user", f"text {i}") for i in range(4096)]
    spans_of(chat.Template(render, context=0), turns, 16)
    assert max(seen) <= 16 * chat.REACH and sum(seen) < 40 * len(turns)
