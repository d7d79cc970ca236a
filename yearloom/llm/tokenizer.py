"""Whole texts to token ids with the tokenizers library, one distinct word or piece of a word at a time.

The word tokenizer splits at white space first, and nothing in its normaliser
or patterns reaches over a space, so a text's ids are the ids of its words in
turn.  A text of plain Latin letters is cut by the tokenizer's own split
pattern, and each worker keeps the ids of pieces it has met: words with marks
beside them, often met once, are not kept.  Of any other text it keeps those of
words: plain ones are cut the same way, the library encodes others as they are.

All this holds for files with the rules of that tokenizer only; with any other
file the library encodes each text as a whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

from yearloom.llm.common import Remembered, hold

#: Words kept in each of a worker's two generations: about 50 MB each.
CACHE_WORDS = 250_000

# The split pattern of the word tokenizer for lower-case ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _rules(path: str) -> dict:
    """All that a tokenizer file says but its vocabulary: what cuts texts, and what happens to the pieces."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = {k: v for k, v in (said.get("model") or {}).items() if k not in ("vocab", "merges")}
    added = [{k: v for k, v in token.items() if k != "id"} for token in said.get("added_tokens") or []]
    return {k: said.get(k) for k in ("normalizer", "pre_tokenizer", "truncation", "padding")} | {"model": model, "added": added}


def by_words(path: str) -> bool:
    """Whether a file has the rules of the word tokenizer, for which texts may be encoded word by word."""
    try:
        known = default_path()
    except ImportError:
        return False
    return path == known or _rules(path) == _rules(known)


def _byte_letters() -> dict[int, str]:
    """For each byte the letter that stands for it in a byte-level vocabulary: itself if printable, else the next from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


class _Words(Remembered):
    """Ids of the words, and of the pieces of words, met lately; a new piece goes through the vocabulary's merges."""

    most = CACHE_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._merged = self._tokenizer.model.tokenize
        self._letters = {b: letter for b, letter in _byte_letters().items() if letter != chr(b)}

    def find(self, word: str) -> bytes:
        if _LETTERS.fullmatch(word):
            return self._piece(word)
        if not _PLAIN.fullmatch(word) or "<|" in word:
            found = self._tokenizer.encode(word, add_special_tokens=False).ids
            return pack(f"<{len(found)}I", *found)
        pieces = _PIECES.findall(word.lower())
        if len(pieces) != 1:  # each piece is one piece when cut again
            return b"".join(map(self.__getitem__, pieces))
        return self._piece(pieces[0])

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        found = [t.id for t in self._merged(piece)]
        return pack(f"<{len(found)}I", *found)


class Encoder:
    """``ids(text)``: the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self._words = _Words(path) if by_words(path) else None
        if self._words is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(path)
            self._whole.no_truncation()
            self._whole.no_padding()

    def ids(self, text: str | None) -> bytes:
        if self._words is None:
            found = self._whole.encode(text or "", add_special_tokens=False).ids
            return pack(f"<{len(found)}I", *found)
        text = (text or "").replace("\n", " ")
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._words.__getitem__, _PIECES.findall(text.lower())))
        if text.isascii() and "<|" not in text:  # fewer distinct words; the tokenizer lowers case itself
            text = text.lower()
        return b"".join(map(self._words.__getitem__, text.split(" ")))

    def forget(self) -> None:
        if self._words is not None:
            self._words.forget()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; what other operators remember is forgotten."""
    own = _encoder(path)
    hold(own)
    return own
