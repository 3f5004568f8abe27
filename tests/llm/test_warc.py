from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultloom.llm import warc
from tests.conftest import SF


def brute(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for data, pages in groups.items():
        named = [p for p in pages if p is not None]
        first = min(named) if len(pages) > 1 and len(data) >= 100 and named else None
        for p in pages:
            again = first is not None and p != first
            out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def read(df, *cols):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *cols).collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert read(warc.round_trip(pages)) == brute([(r.page_id, r.html) for r in pages.collect()])


@pytest.mark.parametrize("split", [1 << 24, 700, 64])
def test_defined_cases(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    rng = random.Random(1)
    same, short = "é" * 60, "x" * 99
    rows = [(i, same) for i in range(50, 10, -1)] + [(i, short) for i in range(60, 65)]
    rows += [(1, None), (2, ""), (None, same), (None, "only " * 40), (None, "only " * 40), (7, "twice " * 30), (7, "twice " * 30), (8, "twice " * 30)]
    rows += [(9, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(100_000)))]
    df = spark.createDataFrame([(h, p, "http://x/\r\né y") for p, h in rows], "html string, page_id long, url string").withColumn("digest", F.lit("q")).repartition(3)
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(df, folder)
    got = warc.read_archives(archives, folder, payload=True)
    assert read(got) == brute(rows)
    assert {r.payload.decode() for r in got.filter("payload IS NOT NULL").collect()} == {h or "" for _, h in rows}
    for a in archives.collect():
        # any gzip reader sees the same records
        assert gzip.open(a.path).read().count(b"WARC/1.1\r\n") > 0
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1 << 24, 5000])
def test_long_urls(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    rng = random.Random(3)
    urls = {1: "data:" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000)),
            2: "http://x/" + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30_000)), 3: "http://x/", 4: "u" * 300_000}
    df = spark.createDataFrame([(u, k, f"html {k} " * 30) for k, u in urls.items()], "url string, page_id long, html string").coalesce(1)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert {k: r.url for k, r in got.items()} == {k: warc._UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], u.encode()).decode() for k, u in urls.items()}


class Plain:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at: at + n]


def test_every_record_has_one_owner_despite_false_magic(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    rng = random.Random(7)
    records, members = [], []
    for i in range(40):
        payload = bytes(rng.choice(b"\x1f\x8b\x08\x00ab") for _ in range(rng.randrange(400)))
        data = warc.encode_record(i, b"u", payload, hashlib.sha256(payload).hexdigest(), None)
        if i % 3 == 0:
            # stored, not compressed: the magic bytes and a whole foreign member lie inside
            inner = zlib.compressobj(0, zlib.DEFLATED, 31)
            raw = zlib.decompress(warc.encode_record(i, b"u", gzip.compress(b"no record"), hashlib.sha256(gzip.compress(b"no record")).hexdigest(), None), 31)
            data = inner.compress(raw) + inner.flush()
        members.append(data)
        records.append(zlib.decompress(data, 31))
    data = b"".join(members)
    for split in (1, 17, 300, 1 << 20):
        got = [r for s in range(0, len(data), split) for r in warc._members(Plain(data), s, min(s + split, len(data)), len(data))]
        assert got == records
    assert [warc.decode_record(r)["page_id"] for r in records] == list(range(40))


def test_damage_is_reported():
    good = zlib.decompress(warc.encode_record(1, b"u", b"payload", hashlib.sha256(b"payload").hexdigest(), None), 31)
    with pytest.raises(ValueError):
        warc.decode_record(good.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(ValueError):
        warc.decode_record(good[:-1])
