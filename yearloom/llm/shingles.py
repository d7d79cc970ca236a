"""Word shingles of whole texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = [_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)]
_PLACE = [_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3), _U(0x1D8E4E27C47D124F)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Bytes whose word hashes are found at a time; texts are cut at white space, so a set never depends on it.
SEGMENT = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _MIX[0]
    h ^= h >> _U(33)
    h = h * _MIX[1]
    return h ^ (h >> _U(33))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def _segment_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of a run of lower-case bytes."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, stop = edge[0::2], edge[1::2]
    up, down = _Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] ^ (stop - start).astype(np.uint64)), start


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, the hashes of its words (between white space, A-Z lowered) in order."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(data):
        cut = min(at + SEGMENT, len(data))
        while cut < len(data) and not _SPACE[data[cut - 1]]:
            ahead = np.flatnonzero(_SPACE[data[cut : cut + SEGMENT]])
            cut = min(len(data), cut + (int(ahead[0]) + 1 if len(ahead) else SEGMENT))
        found, start = _segment_hashes(data[at:cut])
        hashes.append(found)
        starts.append(start + at)
        at = cut
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.split(every, np.searchsorted(where, ends[:-1]))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    use = min(n, width)
    runs = np.full(n - use + 1, _U(use), np.uint64)
    for k in range(use):
        runs += mix(words[k : n - use + 1 + k] * _PLACE[k] + _PLACE[k])
    return np.unique(mix(runs))


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    if not texts:
        return []
    return [shingle_set(w, width) for w in word_hashes([(t or "").encode() for t in texts])]
