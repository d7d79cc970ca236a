"""Token-id files: bit-plane shuffled blocks, one zstandard frame per plane, with a chunk index.

A file holds the ids of whole documents in order.  Ids are cut into blocks of a
fixed size; a block is transposed into byte planes (all first bytes, all second
bytes, ...) or bit planes, and each plane is compressed alone, so the planes of
high bits, nearly constant, cost next to nothing.  Layout::

    magic | blocks: plane frames | doc ids, null flags, lengths (one frame each)
          | chunk index | footer: table and index places, counts, plane kind, block size, magic

The chunk index has, per block, its place, its number of ids and the length of
each plane, so a reader can seek to any block, and to any document by its
lengths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearloom.llm.common import create_file, open_file, rows_of, session, shared_folder, to_batches
from yearloom.llm.tokenizer import default_path, encoder
from yearloom.scale.written import materialise

MAGIC = b"YLPLANE1"
FOOTER = struct.Struct("<QQQQIII8s")
BLOCK_IDS = 65_536
PLANES = {"byte": 4, "bit": 32}

MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; trailing bits of a bit plane's last byte are 0."""
    raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The block that ``split_planes`` cut."""
    if kind == "byte":
        raw = np.empty((n, 4), np.uint8)
        for i, plane in enumerate(planes):
            raw[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, 32), np.uint8)
        for i, plane in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Streams documents into a file; holds one block of ids and 16 bytes a document."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self._out, self._kind, self._block = out, kind, block_ids
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._rest, self._held = [], 0
        self._docs: list[int | None] = []
        self._lengths: list[int] = []
        self._index: list[bytes] = []
        self._at = 0
        self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self._rest.append(ids)
        self._held += len(ids) // 4
        if self._held >= self._block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._rest), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self._block
        for start in range(0, whole, self._block):
            block = ids[start : min(start + self._block, whole)]
            planes = [self._zstd.compress(p) for p in split_planes(block, self._kind)]
            self._index.append(struct.pack(f"<QI{len(planes)}I", self._at, len(block), *map(len, planes)))
            self._put(b"".join(planes))
        self._rest, self._held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        """Writes what is left, the document table, the index and the footer; returns the file's size."""
        self._flush(last=True)
        table_at = self._at
        parts = [
            np.array([d or 0 for d in self._docs], "<i8").tobytes(),
            bytes([d is None for d in self._docs]),
            np.array(self._lengths, "<u8").tobytes(),
        ]
        frames = [self._zstd.compress(p) for p in parts]
        self._put(struct.pack("<3Q", *map(len, frames)) + b"".join(frames))
        index_at = self._at
        self._put(b"".join(self._index))
        kind = list(PLANES).index(self._kind)
        self._put(FOOTER.pack(table_at, index_at, len(self._index), len(self._docs), kind, self._block, 1, MAGIC))
        return self._at


class Reader:
    """Reads a file through its footer and chunk index."""

    def __init__(self, source):
        self._in = source
        size = source.size()
        table_at, index_at, n_blocks, _, kind, _, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.kind = list(PLANES)[kind]
        self._unzstd = zstandard.ZstdDecompressor()
        entry = struct.Struct(f"<QI{PLANES[self.kind]}I")
        raw = self._read(index_at, n_blocks * entry.size)
        self.blocks = [entry.unpack_from(raw, i * entry.size) for i in range(n_blocks)]
        lengths = struct.unpack("<3Q", self._read(table_at, 24))
        docs, nulls, counts = (self._unzstd.decompress(p) for p in _cut(self._read(table_at + 24, sum(lengths)), lengths))
        self.lengths = np.frombuffer(counts, "<u8").astype(np.int64)
        self.docs = [None if null else int(d) for d, null in zip(np.frombuffer(docs, "<i8"), nulls, strict=True)]

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, *lengths = self.blocks[i]
        planes = [self._unzstd.decompress(p) for p in _cut(self._read(at, sum(lengths)), lengths)]
        return join_planes(planes, n, self.kind)

    def pieces(self) -> Iterator[tuple[int, bytes, bool]]:
        """(document number, some of its ids in order, whether they are its last), one block in memory."""
        doc, left = 0, int(self.lengths[0]) if len(self.lengths) else 0
        for i in range(len(self.blocks)):
            ids, at = self.block(i), 0
            while at < len(ids):
                while left == 0:  # documents without ids
                    yield doc, b"", True
                    doc += 1
                    left = int(self.lengths[doc])
                take = min(left, len(ids) - at)
                left -= take
                yield doc, ids[at : at + take].tobytes(), left == 0
                at += take
                if left == 0:
                    doc += 1
                    left = int(self.lengths[doc]) if doc < len(self.lengths) else -1
        while doc < len(self.lengths):
            yield doc, b"", True
            doc += 1


def _cut(data: bytes, lengths) -> Iterator[bytes]:
    at = 0
    for n in lengths:
        yield data[at : at + n]
        at += n


def write_tokens(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, kind: str = "byte", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token-id files in ascending doc_id order; returns the written manifest.

    One row per file: ``shard`` ascends with doc_id (nulls first, equal ids by
    the text's hash), ``path``, ``n_docs``, ``n_ids``, ``n_bytes``.  Null texts
    count as empty; each document ends with ``end_id``.  Repeated rows are
    written as often as they come; other columns are ignored.  An empty table
    gives an empty manifest.  Rows are dealt by range of (doc_id, text hash), so
    even a third of all rows under one doc_id spreads.
    """
    spark = session(docs)
    path, folder = tokenizer or default_path(), shared_folder(spark, "tokens")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, writer, n, shard = encoder(path).ids, None, 0, TaskContext.get().partitionId()
        for doc_id, text in rows_of(batches):
            if writer is None:
                place, out = create_file(folder, f"shard-{shard:06d}", ".ylp")
                writer = Writer(out, kind, block_ids)
            writer.add(doc_id, ids(text) + end)
            n += 1
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": place, "n_docs": n, "n_ids": writer.n_ids, "n_bytes": size}],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialise(dealt.mapInArrow(write, MANIFEST), "token-files")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    session(manifest)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, start in rows_of(batches):
                with open_file(path) as source:
                    reader = Reader(source)
                    crc = 0
                    for doc, ids, last in reader.pieces():
                        crc = zlib.crc32(ids, crc)
                        if last:
                            n = int(reader.lengths[doc])
                            yield reader.docs[doc], start, n, crc
                            start, crc = start + n, 0

        yield from to_batches(rows(), schema)

    # One row per file, so this window holds a few bytes for each file written.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, READ)
