"""WARC archives: deterministic writing and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of
an archive, looks for gzip's magic bytes in it, takes a candidate for a record
only if it decodes to a WARC header, and reads each record that starts inside
its range to its end, beyond the range if need be. Ranges need no index.

Files go through ``pyarrow.fs``, so the folder can be in any store it knows.
A task writes its archive under a name of its own partition; a second attempt
writes the same bytes again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.llm.common import bytes_of, filled, stored
from faultloom.session import run_folder

#: Payloads from this size on are written once; later ones refer to the first.
REVISIT_BYTES = 100
#: Bytes of archive that one reading task scans, and that it fetches at a time.
SPLIT_BYTES, BLOCK, CHUNK = 16 << 20, 1 << 20, 1 << 14
#: Reading tasks at most, as a multiple of the shuffle partitions; beyond that a task reads several ranges.
READ_WAVES = 16
MAGIC = b"\x1f\x8b\x08"
#: What a candidate must decode to, and where its header ends, however long that is.
VERSION, BLANK = b"WARC/1.", b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")


def _name(page: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page is None else b"%d" % page)


def encode_record(page: int | None, url: bytes, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record as a gzip member; a revisit of page ``response`` if that is given."""
    uri = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url) or b"urn:page:"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if response is None else b"revisit"), b"WARC-Record-ID: " + _name(page),
            b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha256:" + digest.encode()]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if response is not None:
        head += [b"WARC-Refers-To: " + _name(response), b"WARC-Profile: " + SAME_PAYLOAD.encode()]
    block = http if response is not None else http + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _page(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:"): -1]
    return int(digits) if digits else None


def decode_record(data: bytes) -> dict:
    """The fields of a whole decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record and Content-Length differ")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": stated, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload}


def _write(folder: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        # attempts do not share a file; the one that ends last puts the same bytes in its place
        own = f"{root}/.attempt-{task.taskAttemptId()}"
        size = 0
        with store.open_output_stream(own, compression=None) as out:
            for b in chain([first], batches):
                size += _append(out, b)
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], fields)

    return run


def _append(out, b: pa.RecordBatch) -> int:
    size = 0
    urls, pages, digests, refers = (b.column(i) for i in range(1, 5))
    raw, offs = bytes_of(filled(b.column(0)))
    uraw, uoffs = bytes_of(filled(urls))
    for i, (page, digest, response) in enumerate(zip(pages.to_pylist(), digests.to_pylist(), refers.to_pylist(), strict=True)):
        record = encode_record(page, uraw[uoffs[i]: uoffs[i + 1]].tobytes(), raw[offs[i]: offs[i + 1]].tobytes(), digest, response)
        out.write(record)
        size += len(record)
    return size


def write_archives(df: DataFrame, folder: str, html: str = "html", url: str = "url", key: str = "page_id", least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record per row of ``df``; gives path and size of every archive.

    Null html is an empty payload. Of rows with equal payloads of ``least``
    bytes or more, those with the smallest key are responses and the others
    revisits of it. Rows without a key are responses unless a keyed row has
    their payload. Repeated rows (same key and payload) are written as often as
    they occur, with one record type. An empty table gives no archives.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    pages = df.select(body.alias("payload"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{key}`").cast("long").alias("page"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    # the map side combines, so a payload that most rows share reaches a task once for each partition
    shared = pages.filter(large).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    joined = pages.join(shared.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & large, "left")
    response = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])
    return stored(joined.select("payload", "url", "page", "digest", response.alias("response")).mapInArrow(_write(folder, shape.names), shape))


class _Bytes:
    """Random access to an archive through one block of it at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.block, self.base = file, size, b"", 0

    def get(self, at: int, n: int = CHUNK) -> bytes:
        if at < self.base or min(at + n, self.size) > self.base + len(self.block):
            self.block, self.base = self.file.read_at(min(BLOCK, max(0, self.size - at)), at), at
        return self.block[at - self.base: at - self.base + n]

    def magic(self, at: int, end: int) -> int:
        """Where the next member may start, or ``end``."""
        while at < end:
            part = self.get(at)
            if (found := part.find(MAGIC)) >= 0:
                return min(at + found, end)
            if len(part) < CHUNK:
                break
            at += len(part) - len(MAGIC) + 1
        return end


def _member(data: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The decoded record that starts at ``at`` and where it ends; None if no record does."""
    unpack, record, begun, whole = zlib.decompressobj(31), bytearray(), False, False
    try:
        while not unpack.eof:
            part = data.get(at)
            if not part:
                return None
            seen = max(0, len(record) - len(BLANK) + 1)
            record += unpack.decompress(part)
            at += len(part)
            if not begun and (len(record) >= len(VERSION) or unpack.eof):
                begun = True
                if not record.startswith(VERSION):
                    return None
            if not whole and (end := record.find(BLANK, seen)) >= 0:
                whole = True
                if record.find(b"\r\nContent-Length: ", 0, end) < 0:
                    return None
    except zlib.error:
        return None
    return (bytes(record), at - len(unpack.unused_data)) if whole else None


def _members(file, at: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded records that start in [at, end)."""
    data = _Bytes(file, size)
    while (at := data.magic(at, end)) < end:
        found = _member(data, at)
        if found is None:
            # the magic bytes by chance, inside compressed data
            at += 1
        else:
            record, at = found
            yield record


def _read(folder: str, payload: bool, shape: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for record in _members(file, start, min(size, start + SPLIT_BYTES), size):
                        row = decode_record(record)
                        rows.append(row)
                        held += len(record)
                        if held >= SPLIT_BYTES:
                            yield pa.RecordBatch.from_pylist([{f: r[f] for f in shape.names} for r in rows], schema=shape)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{f: r[f] for f in shape.names} for r in rows], schema=shape)

    return run


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """A row per record of the archives (path, size), read by byte ranges.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and
    ``payload`` if asked for (null for revisits). Lengths and digests are
    checked on reading. No archives give no rows.
    """
    splits = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SPLIT_BYTES).cast("long"))).alias("start"))
    fields = [("page_id", T.LongType(), pa.int64()), ("url", T.StringType(), pa.string()), ("payload_bytes", T.LongType(), pa.int64()),
              ("payload_digest", T.StringType(), pa.string()), ("record_type", T.StringType(), pa.string()), ("refers_to", T.LongType(), pa.int64())]
    if payload:
        fields.append(("payload", T.BinaryType(), pa.binary()))
    shape = T.StructType([T.StructField(n, t) for n, t, _ in fields])
    # the table of ranges is tiny, so its size must not decide on the number of tasks
    spark = archives.sparkSession
    tasks = max(1, min(splits.count(), READ_WAVES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return splits.repartition(tasks).mapInArrow(_read(folder, payload, pa.schema([(n, t) for n, _, t in fields])), shape)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes ``df`` to archives in the shared folder and reads the records back."""
    folder = f"{run_folder(df.sparkSession)}/warc"
    folder = re.sub(r"^(?:file:)?/+", "file:///", folder)
    return read_archives(write_archives(df, folder, **options), folder).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
