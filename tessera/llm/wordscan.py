"""Vectorised scanning of words over Arrow text columns.

A word is a run of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. In UTF-8 that is a run of the bytes 0-9, a-z and
0x80-0xFF, so words are found on the bytes of a whole block of texts at once, without decoding.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .common import cache

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
WORD_VALUE = np.where(IS_WORD, BYTE_VALUE, np.uint64(0))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


cache("powers", _powers.cache_clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size <<= 1
    up, down = _powers(size)
    return up[:n], down[:n]


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and each text's start in them, one more at the end. The column holds no nulls."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of a block: data (lower-cased bytes), text_at (start of each text, and the end), start and end of each word in data,
    first (number of words before each text, and the total), hash (uint64 of each word)."""

    def __init__(self, col: pa.Array, hashed: bool = True) -> None:
        raw, self.text_at = raw_bytes(col)
        self.data = data = LOWER[raw]
        word = IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.text_at] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.is_word = word
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.text_at)
        self.hash = self._hashes() if hashed else np.zeros(0, np.uint64)

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data))
        total = np.add.reduceat(WORD_VALUE[self.data] * up, self.start)
        # Neighbouring texts may touch without a gap, so that a sum could only run over bytes of its own word: gaps count 0.
        return mix64(total * down[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words(pa.array([word])).hash[0])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (over the whole block; the caller drops those that cross texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[i : i + n]
    return mix64(out)


def inside(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """For each of the block's k-grams, whether it lies in one text."""
    ok = np.ones(max(0, n_words - k + 1), bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
