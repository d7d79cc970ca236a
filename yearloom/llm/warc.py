"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; after the frames a bundle has a
seek table in a skippable frame (the public seekable format), so any
Zstandard tool can read it as a whole.  The index, a table, maps a record's
identifier to its bundle, frame and place within the frame's plain bytes: one
record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.llm.common import create_file, open_file, rows_of, session, shared_folder, to_batches
from yearloom.scale.written import materialise

# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 512 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier[len("<urn:page:") : -1]
    return None if number == "null" else int(number)


def record_bytes(page_id, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record without it."""
    uri = "".join(c for c in url or "" if c > " ") or "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC headers, HTTP headers, payload, and the record's length, from bytes that start with a record."""
    head_end = _find(data, b"\r\n\r\n")
    head = _headers(bytes(data[:head_end]))
    start = head_end + 4
    end = start + int(head["Content-Length"])
    block = bytes(data[start:end])
    cut = block.index(b"\r\n\r\n")
    return head, _headers(block[:cut]), block[cut + 4 :], end + 4


def _find(data: memoryview, mark: bytes, step: int = 1024) -> int:
    at = step
    while (found := bytes(data[:at]).find(mark)) < 0:
        if at > len(data):
            raise ValueError("no end of headers")
        at *= 2
    return found


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines)


class BundleWriter:
    """Streams records into frames of about ``frame_bytes``; one frame is in memory."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._out, self._most = out, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._held: list[bytes] = []
        self._size = 0
        self._frames: list[tuple[int, int]] = []
        self.n_bytes = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame number and its offset in that frame."""
        if self._held and self._size + len(record) > self._most:
            self._end_frame()
        place = len(self._frames), self._size
        self._held.append(record)
        self._size += len(record)
        return place

    def _end_frame(self) -> None:
        plain = b"".join(self._held)
        packed = self._zstd.compress(plain)
        self._out.write(packed)
        self.n_bytes += len(packed)
        self._frames.append((len(packed), len(plain)))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._end_frame()
        table = b"".join(ENTRY.pack(*f) for f in self._frames) + FOOTER.pack(len(self._frames), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Random access to a bundle through its seek table."""

    def __init__(self, source):
        self._in = source
        size = source.size()
        n, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        raw = self._read(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = ENTRY.unpack_from(raw, i * ENTRY.size)
            self.frames.append((at, packed, plain))
            at += packed
        self._unzstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def frame(self, i: int) -> memoryview:
        at, packed, plain = self.frames[i]
        return memoryview(self._unzstd.decompress(self._read(at, packed), max_output_size=plain))


INDEX = "page_id long, path string, frame long, at long, length long"


def with_origin(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``sha1`` (hex) and ``refers_to``: the page whose payload this one repeats, else null.

    Counting is combined before the shuffle, and the join keeps one row per
    repeated digest on its other side, so adaptive execution can split a
    digest that a third of all rows have.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("long", F.length("payload") >= revisit_bytes)
    first = (
        rows.filter("long").groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
        .filter("n > 1 and first is not null").select("sha1", "first")
    )
    repeats = F.col("long") & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return rows.join(first, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.when(repeats, F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the written index: page_id, path, frame, at, length.

    Null html is an empty payload.  Of equal payloads of ``revisit_bytes`` or
    more, the row with the largest page_id is the response and the others
    revisit it; rows that repeat that page_id as well are responses too, and a
    null page_id is only ever a revisit, or a response if no other row has the
    payload.  Other columns are ignored; an empty table gives an empty index.
    """
    spark = session(pages)
    folder = shared_folder(spark, "warc")
    schema = pa.schema(
        [("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            writer, task, number = None, TaskContext.get().partitionId(), 0
            for page_id, url, payload, sha1, refers_to in rows_of(batches):
                if writer is not None and writer.n_bytes >= bundle_bytes:
                    writer.close()
                    out.close()
                    writer, number = None, number + 1
                if writer is None:
                    path, out = create_file(folder, f"bundle-{task:06d}-{number:04d}", ".warc.zst")
                    writer = BundleWriter(out, frame_bytes)
                record = record_bytes(page_id, url, payload, bytes.fromhex(sha1), refers_to, refers_to is not None)
                frame, at = writer.add(record)
                yield page_id, path, frame, at, len(record)
            if writer is not None:
                writer.close()
                out.close()

        yield from to_batches(rows(), schema)

    return materialise(with_origin(pages, revisit_bytes).mapInArrow(write, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(index: DataFrame) -> DataFrame:
    """Reads every record of an index's bundles through its frame, offset and length.

    Per record: page_id, payload_bytes and payload_digest of the full payload
    (bare hex SHA-1), record_type, refers_to.  A response's payload is hashed
    again; one that differs from its header is an error.
    """
    session(index)
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            path = frame = None
            for place, number, at, length in rows_of(batches):
                if place != path:
                    if path is not None:
                        source.close()
                    source = open_file(place)
                    reader, path, frame = BundleReader(source), place, None
                if number != frame:
                    plain, frame = reader.frame(number), number
                head, http, payload, size = parse_record(plain[at : at + length])
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = head["WARC-Type"]
                if size != length or kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record {head['WARC-Record-ID']} in {place}")
                refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                yield page_of(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers

        yield from to_batches(rows(), schema)

    places = index.select("path", "frame", "at", "length")
    # A frame is the unit of reading: all its records go to one task.
    return places.repartition("path", "frame").sortWithinPartitions("path", "frame", "at").mapInArrow(read, READ)


def read_record(path: str, frame: int, at: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its index entry: WARC headers, HTTP headers, payload."""
    with open_file(path) as source:
        return parse_record(BundleReader(source).frame(frame)[at : at + length])[:3]
