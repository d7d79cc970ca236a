"""Byte-level BPE: texts to ids and ids back to bytes, with the tiktoken library and a local rank file.

The library matches the split pattern one after the other and merges each match
by rank.  Two things it does not bound are bounded here: what one call returns,
and the depth to which its pattern backs off in a long run of white space.  A
long text is cut before white space that follows something else; no
match of the pattern reaches over such a place and none looks behind itself, so
the parts' ids are the text's.  A long run of white space is one match of its
own (without its last character, where more text follows), which is merged
without the pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.llm.common import rows_of, session

#: Characters of a part at least, where a text is longer.
PART_CHARS = 65_536
#: White space from which a run is merged without the pattern; the library's pattern fails at runs of about a million.
LONG_RUN = 4_096

# The code points that the pattern's \s stands for.
_SPACE_POINTS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = "".join(map(chr, _SPACE_POINTS))
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parts(text: str, part_chars: int = PART_CHARS) -> Iterator[tuple[bool, str]]:
    """(is one match, part) of a text in order: safe to encode apart from each other.

    Holds for patterns whose matches have white space at their beginning only,
    or are white space alone and leave its last character to what follows.
    """
    at = 0
    for run in _RUN.finditer(text) if len(text) > part_chars else ():
        yield from ((False, p) for p in _between(text, at, run.start(), part_chars))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield True, text[run.start() : at]
    yield from ((False, p) for p in _between(text, at, len(text), part_chars))


def _between(text: str, at: int, end: int, part_chars: int) -> Iterator[str]:
    while end - at > part_chars:
        place = _CUT.search(text, at + part_chars, end)
        if not place:
            break
        yield text[at : place.start()]
        at = place.start()
    if end > at:
        yield text[at:end]


class Coder:
    """A rank file's encoder and decoder."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return self._library.encode_ordinary(text)
        found: list[int] = []
        for one_match, part in parts(text):
            found += self._library._encode_single_piece(part) if one_match else self._library.encode_ordinary(part)
        return found

    def bytes(self, ids: list[int]) -> bytes:
        return self._library.decode_bytes(ids)


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """The worker's coder; one is kept."""
    return Coder(path, pattern)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text; no special tokens, their strings are ordinary text.

    A null text is empty and has no ids.  Rows with null or repeated doc_ids are
    encoded as they come; other columns are ignored; an empty table gives no
    rows.  Nothing is shuffled, so no key can be hot; a very long text costs one
    task its length.
    """
    session(docs)
    path, split = ranks or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(path, split).ids
        for batch in batches:
            ids = [ids_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``coded`` (doc_id, ids) with ``decoded``, the bytes of the ids; they need not be whole characters.

    Null ids give null bytes, no ids empty ones; repeated rows the same each;
    other columns are dropped; an empty table gives no rows.
    """
    session(coded)
    path, split = ranks or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = coder(path, split).bytes
        for batch in batches:
            made = [None if ids is None else bytes_of(ids) for (ids,) in rows_of([batch.select([1])])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` gives."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
