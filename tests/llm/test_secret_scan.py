from __future__ import annotations

import hashlib
import random
import re
import time

from faultloom.llm import secret_scan as ss
from tests.conftest import SF

SLOW = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def slow(text):
    kinds = list(SLOW)
    found = [(m.start(), kinds.index(k), m.end()) for k, (rx, ok) in SLOW.items() for m in rx.finditer(text or "") if ok(m)]
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k + ":") for s in want) for k in SLOW)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(ss.span_digest(ss.secret_spans(docs)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_random_and_defined_cases(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "toKen", "ſecret", "toKen", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "é", "AKIA", "AKIAAKIA",
             "ABCDEFGHIJKLMNOPQRS", "0123456789abcdef", "abcdef", "deadbeefdeadbeef", "G", "/_.=-+", "\n", "x1"]
    texts = dict(enumerate("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)))
    texts |= {1000: None, 1001: "", 1002: "é" * 200_000 + " token=abcdef123", None: "password: hunter22"}
    df = spark.createDataFrame([(t, k, "x") for k, t in texts.items()], "text string, doc_id long, spans string")
    check(ss.span_digest(ss.secret_spans(df)).collect(), texts)
    assert ss.secret_spans(df.limit(0)).count() == 0


def test_novelty_finds_random_strings_only():
    rng = random.Random(4)
    scanner = ss.Scanner()
    words = "the value of a connection is stored in settings_module_2 and settings_module_2 is read again".split()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = 0
    for _ in range(200):
        text = [rng.choice(words) for _ in range(60)]
        key = "".join(rng.choice(alphabet) for _ in range(32))
        planted = " ".join(text) + f" authorization bearer {key} " + " ".join(text[::-1])
        found += any(k == 3 and planted[s:e] == key for s, k, e, _ in scanner.spans(planted.encode()))
        plain = " ".join(text) + " authorization in settings_module_2_settings_module_2  and zzzzzzzz00000000zzzzzzzz " + " ".join(text[::-1])
        assert not scanner.spans(plain.encode())
    assert found >= 190


def test_repeated_strings_are_found_at_each_place():
    rng = random.Random(5)
    scanner = ss.Scanner()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the value of a connection is stored in the settings of this page and read again by many people".split()
    places = once = 0
    for i in range(300):
        key = "".join(rng.choice(alphabet) for _ in range(16 + i % 49)) + "7a"
        prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
        start, end = prose(30), prose(30)
        text = f"{start} authorization bearer {key} {prose(10)} authorization bearer {key} {prose(10)} name={key} {end}"
        spans = scanner.spans(text.encode())
        places += sum(k == 3 and text[s:e] == key for s, k, e, _ in spans)
        once += len(scanner.spans(f"{start} authorization bearer {key} {end}".encode()))
    assert once >= 290 and places >= 2 * once - 10
    # a copy that the edge of the surroundings cuts counts as little as a whole one
    key = "".join(rng.choice(alphabet) for _ in range(60)) + "7a"
    values = {scanner.novelty(text.encode(), len(text) - 62, len(text)) > ss.NOVEL for gap in range(430, 530) for text in [f"{key}{('so on ' * 90)[:gap]}{key}"]}
    assert values == {True}
    # the value alone repeats what a longer candidate holds
    text = f"authorization bearer session={key} for all requests, or as the bearer {key} of one"
    assert [text[s:e] for s, _, e, _ in scanner.spans(text.encode())] == [f"session={key}", key]


def test_strings_of_one_kind_of_character_are_measured():
    rng = random.Random(6)
    scanner = ss.Scanner()
    words = "the value of a connection is stored in the settings of this page and read again by many people".split()
    lower = "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (lower + lower.upper(), lower.upper(), lower, "0123456789"):
        found = 0
        for i in range(100):
            key = "".join(rng.choice(alphabet) for _ in range(16 + i % 33))
            text = " ".join(rng.choice(words) for _ in range(40)) + f" authorization bearer {key} " + " ".join(rng.choice(words) for _ in range(40))
            # digits alone are a known form from 24 on
            found += any(k in (2, 3) and text[s:e] == key for s, k, e, _ in scanner.spans(text.encode()))
            # long runs without news stay out, letters or marks
            plain = text.replace(key, "theconnectionisstoredinthesettings ---------------------------------------- connection_connection_connection")
            assert not scanner.spans(plain.encode())
        assert found >= (90 if alphabet == lower else 95), alphabet


def slow_new(scanner, text, known):
    """The candidates of each context word in turn, looked for anew."""
    taken, done, k = 0, 0, 0
    for m in ss.CONTEXT.finditer(text):
        for c in ss.CANDIDATE.finditer(text, max(m.end(), done)):
            s, e = c.span()
            if s > m.end() + ss.REACH:
                break
            done = e
            while k < len(known) and known[k][0] < e:
                taken, k = max(taken, known[k][2]), k + 1
            if s >= taken and (value := scanner.novelty(text, s, e)) >= scanner.novel:
                yield s, 3, e, value


def test_candidates_are_those_of_each_context_word():
    rng = random.Random(7)
    scanner = ss.Scanner(novel=-9.0)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(300):
        parts = [rng.choice(["token", "bearer ", " key ", "private_key", " ", ", ", "=", "word", "secret: ", "AKIA" + "A" * 17, "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 15, 16, 17, 40])))]) for _ in range(rng.randrange(40))]
        text = "".join(parts).encode()
        known = sorted(s for s in scanner.spans(text) if s[1] < 3)
        assert list(scanner._new(text, known)) == list(slow_new(scanner, text, known))


def test_copies_are_the_longest_from_the_left():
    rng = random.Random(8)
    for _ in range(300):
        parts = ["".join(rng.choice("ab") for _ in range(rng.choice([3, 16, 16, 17]))) for _ in range(rng.randrange(1, 4))]
        string = "=".join(parts).encode()
        text = b"".join(rng.choice([string, *(p.encode() for p in parts), b"a", b"b=", b" "]) for _ in range(20))
        wanted = {string, *(p for p in string.split(b"=") if ss.CANDIDATE.fullmatch(p))}
        rx = re.compile(b"|".join(re.escape(p) for p in sorted(wanted, key=lambda p: (-len(p), p))))
        assert list(ss._places(string, text)) == [m.span() for m in rx.finditer(text)]


def test_long_texts_take_linear_time():
    scanner = ss.Scanner()
    rng = random.Random(9)
    values = ["%016x" % rng.getrandbits(64) + "g" for _ in range(300_000)]
    texts = [
        b"the token is here and " * 240_000, ("bearer " + "=".join(values)).encode(), b"token" * 1_000_000,
        (" ".join(f"word{i % 977}" for i in range(700_000)) + " key").encode()]
    for text in texts:
        assert len(text) >= 4_900_000
        t0 = time.process_time()
        scanner.spans(text)
        assert time.process_time() - t0 < 10
