"""Bounded-space online best-fit packing of token sequences.

Documents are encoded where they are read; only their lengths and checksums
move.  Pieces are dealt over parts by a hash and meet in hash order, and each
part packs them online: a piece goes to the open bin with the least free space
that still holds it, found in an integer used as a bitset keyed by free space.
When the fixed number of open bins is reached, the fullest closes first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.llm.common import rows_of, session, to_batches
from yearloom.llm.tokenizer import default_path, encoder
from yearloom.scale.written import materialise

SEQUENCE = 4096
#: Bins that a part keeps open.
OPEN_BINS = 2048
#: Sequences that one part makes at least, so that the bins left open at its end are a small share.
PART_SEQUENCES = 20_000


class BestFit:
    """Open bins in stacks by free space; bit f of ``_free`` is set while some bin has f free."""

    def __init__(self, capacity: int, open_bins: int):
        self._capacity, self._most = capacity, open_bins
        self._free, self._open, self._next = 0, 0, 0
        self._bins: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        stack = self._bins[free]
        number = stack.pop()
        if not stack:
            self._free &= ~(1 << free)
        self._open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece of ``length`` and the place in it."""
        fitting = self._free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self._capacity, self._next
            self._next += 1
        left = free - length
        if left:
            self._bins[left].append(number)
            self._free |= 1 << left
            self._open += 1
            if self._open > self._most:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
        return number, self._capacity - free


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = SEQUENCE) -> DataFrame:
    """The pieces of each document's ids and end id: only documents over ``capacity`` are cut."""
    session(docs)
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            ids_of = encoder(path).ids
            for doc_id, text in rows_of(batches):
                ids = memoryview(ids_of(text) + end)
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    yield doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)

        yield from to_batches(rows(), _PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    part_sequences: int = PART_SEQUENCES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and still have their end id.  Repeated rows and null
    doc_ids are packed as often as they come; texts longer than a sequence are
    cut, however long; which of equal pieces lies where has no meaning; other
    columns are ignored; an empty table gives no rows.  Parts follow the number of tokens, so each makes
    about ``part_sequences`` sequences whatever the input.
    """
    written = materialise(pieces(docs, tokenizer, end_id, capacity), "pieces")
    tokens = written.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-tokens // (capacity * part_sequences)))
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            where = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where[:, 0] + base), pa.array(where[:, 1])], schema=schema
            )

    # A row's place in the written table is part of the hash, so that equal pieces are dealt over all parts.
    order = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = written.withColumn("h", order).repartition(parts, "h").sortWithinPartitions("h", "doc_id", "piece").drop("h")
    return dealt.mapInArrow(fill, f"{PIECES}, sequence_id long, offset long")
