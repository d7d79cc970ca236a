import struct
import zlib

import numpy as np
import pytest

from yearloom.llm import packing, tokenizer, tokens
from yearloom.llm.common import create_file, open_file
from yearloom.llm.tokenizer import Encoder, default_path

ODD = [
    "İstanbul ΣΑΣ naïve café  x y z　q <|endoftext|> a<|startoftext|>b it's DON'T 12³ ½ ß ẞ ǅ", "", "\x1c a\x85b ​ c",
    "́ a ̀", "x﻿y ªº Ⅷ", "a\x00b <| x|>", "’s ´a` ×÷ a×b", "A\r\nB\tC\x0b\x0cD", "ＡＢ '''s's're $$$!!", "é é ÀÉ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    cased = json.loads(open(default_path(), encoding="utf-8").read())
    cased["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    texts = ["Hello  World", "it's A\nnew Line, über 12 x", "", None, "lower words only"]
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        whole, own = Tokenizer.from_file(path), Encoder(path)
        for text in texts:
            assert np.frombuffer(own.ids(text), np.uint32).tolist() == whole.encode(text or "", add_special_tokens=False).ids
    (tmp_path / "same.json").write_text(open(default_path(), encoding="utf-8").read())
    assert tokenizer.by_words(str(tmp_path / "same.json"))


def test_words_give_the_ids_of_whole_texts(library, gibberish):
    encoder = Encoder(default_path())
    for text in [*ODD, *(gibberish(i, 200) for i in range(5)), gibberish(9, 3).title() + ".\n" + gibberish(8, 50)]:
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == library(text), text


def test_plain_texts_are_kept_by_pieces(library):
    encoder = Encoder(default_path())
    for text in ["It's as said. AS. (as) as, ÀÉß! ÿ's 2nd 12", "  a  b\n\n'S 'll''ve A'D don'ts?!  ", "Ça  été, l'Œuvre\tas. <|x|> as."]:
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == library(text), text
    first = Encoder(default_path())
    first.ids("as. (as) as, AS! As; ÇA ça.")
    assert {"as", "ça"} <= set(first._words) and not [w for w in first._words if len(w) > 2]


def test_cache_limit_changes_nothing(library, gibberish, monkeypatch):
    monkeypatch.setattr("yearloom.llm.tokenizer._Words.most", 10)
    encoder = Encoder(default_path())
    for i in range(5):
        text = gibberish(i, 100)
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == library(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (tokens.join_planes(tokens.split_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_over_block_edges(tmp_path, kind):
    path, out = create_file(str(tmp_path), "x", ".ylp")
    writer = tokens.Writer(out, kind, block_ids=16)
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, n, dtype=np.uint32)) for i, n in enumerate([0, 3, 16, 40, 0, 0, 1, 100, 0])]
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    out.close()
    with open_file(path) as source:
        reader = tokens.Reader(source)
        assert reader.docs == [d for d, _ in docs]
        assert len(reader.blocks) == 10
        back = {}
        for doc, ids, last in reader.pieces():
            back[doc] = back.get(doc, b"") + ids
        assert [back[i] for i in range(len(docs))] == [ids.tobytes() for _, ids in docs]
        assert reader.block(1).tolist() == np.concatenate([i for _, i in docs])[16:32].tolist()  # any block alone


def expected(rows, library, end):
    return sorted(((d if d is not None else -1), [*library(t), end]) for d, t in rows)


def test_written_tokens_read_back(spark, docs, library, gibberish):
    rows = [(5, "a b"), (3, None), (None, "no id"), (4, ""), (9, gibberish(1, 3000)), (5, "a b"), *((20 + i, t) for i, t in enumerate(ODD))]
    got = tokens.read_tokens(tokens.write_tokens(docs(rows), block_ids=64)).collect()
    want, start = [], 0
    for d, ids in expected(rows, library, 2):
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((d, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_no_documents(spark, docs):
    empty = docs([]).filter("false")
    assert tokens.read_tokens(tokens.write_tokens(empty)).count() == 0
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, open_bins=2)
    assert bins.place(6) == (0, 0)  # 4 free
    assert bins.place(7) == (1, 0)  # 3 free
    assert bins.place(3) == (1, 7)  # fits both; the fuller one, which is full now
    assert bins.place(5) == (2, 0)  # 5 free
    assert bins.place(8) == (3, 0)  # 2 free: three open, so the fullest, this one, closes
    assert bins.place(2) == (0, 6)


def test_packing_is_whole_and_tight(spark, docs, library, gibberish):
    rows = [(i, gibberish(i, 5 + (i * 37) % 60)) for i in range(150)] + [(None, "x"), (7, None), (7, None), (500, gibberish(3, 400))]
    got = packing.pack(docs(rows), capacity=128).collect()
    want = []
    for d, ids in expected(rows, library, 1):
        want += [
            (d, k, at, len(ids[at : at + 128]), zlib.crc32(np.array(ids[at : at + 128], "<u4").tobytes()))
            for k, at in enumerate(range(0, len(ids), 128))
        ]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 128 + 2


def test_equal_pieces_are_dealt_over_all_parts(spark, docs):
    """A third of all rows alike, and a very long text."""
    rows = [(7, "the same words again", "a") if i % 3 == 0 else (i, f"some other words {i}", "a") for i in range(3000)]
    got = packing.pack(docs([*rows, (9000, "long " * 30_000, "a")]), capacity=256, part_sequences=5).collect()
    assert sum(r.doc_id == 7 for r in got) == 1001  # row 7 itself has another text
    parts = {r.sequence_id >> 40: 0 for r in got}
    for r in got:
        parts[r.sequence_id >> 40] += r.doc_id == 7
    assert len(parts) > 5 and max(parts.values()) < 2 * 1001 / len(parts) + 50
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 9000)
    assert [s for _, s, _ in long] == list(range(0, sum(n for *_, n in long), 256)) and {n for *_, n in long[:-1]} == {256}
