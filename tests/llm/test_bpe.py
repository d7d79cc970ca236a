import base64
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from yearloom.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_path(), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merged(ranks, piece: bytes):
    """A piece's ids by definition: merge the neighbours of least rank until none is known."""
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[t] for t in tokens]
        i = min(pairs)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def brute_force(ranks, text):
    return [i for m in regex.findall(bpe.default_pattern(), text) for i in merged(ranks, m.encode())]


ODD = [
    "", "a", " ", "  a", "a  ", "don't I'll we've 'tis", "x  y", "a\x1c\x1db 　c", "été naïve Straße ÄÖÜ", "日本語 テスト",
    "<|endoftext|> [INST] </s>", "12 345,67 8", "\n\n\n  \t x", "🙂🙂 a🙂", "á é", "''s 's", "​ zero ﻿", "   ", "…—“quoted”",
]


def test_ids_equal_the_merges_by_definition(spark, docs, ranks, gibberish):
    texts = [*ODD, gibberish(1, 300), None]
    coded = bpe.decode(bpe.encode(docs(texts).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("x"))))
    rows = {r.doc_id: r for r in coded.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i].ids == brute_force(ranks, text or "")
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_digest(spark, docs, ranks):
    row = bpe.digest(bpe.decode(bpe.encode(docs(["don't  stop"])))).first()
    ids = brute_force(ranks, "don't  stop")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"don't  stop").hexdigest()
    empty = bpe.digest(bpe.decode(bpe.encode(docs([None])))).first()
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("part_chars", [1, 7, 50])
def test_parts_are_safe_to_encode_apart(ranks, monkeypatch, part_chars):
    monkeypatch.setattr(bpe, "PART_CHARS", part_chars)
    monkeypatch.setattr(bpe, "_RUN", __import__("re").compile(f"[{bpe._SPACE}]{{5,}}"))
    monkeypatch.setattr(bpe.parts, "__defaults__", (part_chars,))
    coder, r = bpe.Coder(bpe.default_path(), bpe.default_pattern()), random.Random(part_chars)
    letters = "ab'sé1 2 \n\t　\x1c.,—日 "
    for _ in range(400):
        text = "".join(r.choice(letters) * r.choice((1, 1, 1, 2, 9)) for _ in range(r.randrange(40)))
        assert "".join(p for _, p in bpe.parts(text)) == text
        assert coder.ids(text) == brute_force(ranks, text)


def test_very_long_texts(spark, docs):
    """Runs of white space at which the library alone fails, a long text of one word, and many words."""
    texts = [" " * 1_500_000 + "x", "a b" + "\n" * 1_200_000, "ab" * 400_000, "some words 12, " * 60_000]
    for row in bpe.decode(bpe.encode(docs(texts))).collect():
        assert bytes(row.decoded).decode() == texts[row.doc_id]
    once = bpe.Coder(bpe.default_path(), bpe.default_pattern())
    assert once.ids(texts[3]) == once._library.encode_ordinary(texts[3])


def test_parts_of_characters_and_empty_tables(spark, docs):
    ids = bpe.encode(docs(["日"])).first().ids
    half = spark.createDataFrame([(1, ids[:1]), (1, None), (None, [])], "doc_id long, ids array<int>")
    got = [None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(half).collect()]
    assert got[1:] == [None, b""] and "日".encode().startswith(got[0]) and got[0]
    assert bpe.decode(bpe.encode(docs([]))).count() == 0


def test_repeated_and_null_ids_stay(spark, docs):
    rows = bpe.encode(docs([(None, "a b"), (3, "a b"), (3, "a b"), (3, "c")])).collect()
    assert sorted((r.doc_id is None, len(r.ids)) for r in rows) == [(False, 1), (False, 2), (False, 2), (True, 2)]
