"""Token ids of whole Arrow blocks, as the `tokenizers` library gives them for a byte-level BPE file.

Byte-level BPE cuts a text into pre-tokens by a fixed pattern and encodes each by itself. Here the pattern's cuts are found for a whole
block of bytes at once, each distinct pre-token is encoded by the library once, and ids are gathered. A text with characters for which
the cuts are not certain (anything but ASCII and Latin letters, or a special token's own string) goes through the library whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import cache
from .wordscan import BYTE_VALUE, mix64, powers, raw_bytes

END_ID = 0
#: Distinct pre-tokens that a worker keeps the ids of.
CACHE_ENTRIES = 1_000_000

LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte outside of the two-byte characters U+0080 to U+00BF, and that of those by their second byte."""
    one = np.full(256, UNSURE, np.uint8)
    for b in range(0x20, 0x7F):
        ch = chr(b)
        one[b] = LETTER if ch.isalpha() else NUMBER if ch.isdigit() else OTHER
    one[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    one[0x80:0xC0] = LETTER  # goes with its lead byte
    one[0xC2:0xC9] = LETTER  # U+00C0 to U+023F are letters but for two signs
    two = np.full(256, OTHER, np.uint8)
    for b in range(0x80, 0xC0):
        ch = chr(b)
        two[b] = UNSURE if ch.isspace() else LETTER if ch.isalpha() else NUMBER if ch.isnumeric() else OTHER
    return one, two


CLASS, CLASS_C2 = _byte_classes()
#: Endings that the pattern cuts off with their apostrophe, in the pattern's order. Fixed values.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def token_starts(b: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin in the bytes of a block, and for each text whether that is certain. Pre-tokens fill their text."""
    n = len(b)
    sure = np.ones(len(text_at) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), sure
    cls = CLASS[b]
    at = np.flatnonzero(b[:-1] == 0xC2)
    cls[at] = cls[at + 1] = CLASS_C2[b[at + 1]]
    at = np.flatnonzero(b[:-1] == 0xC3)
    at = at[(b[at + 1] == 0x97) | (b[at + 1] == 0xB7)]
    cls[at] = cls[at + 1] = OTHER
    doubt = np.flatnonzero(cls == UNSURE)
    sure[np.searchsorted(text_at, doubt, side="right") - 1] = False
    edge = np.zeros(n + 1, bool)
    edge[text_at] = True
    run = edge[:-1].copy()
    run[1:] |= cls[1:] != cls[:-1]
    s = np.flatnonzero(run)
    e = np.append(s[1:], n)
    kind = cls[s]
    starts = np.zeros(n + 1, bool)
    word = kind != SPACE
    ws = s[word]
    begins_text = edge[ws]
    spaced = ~begins_text & (b[np.maximum(ws - 1, 0)] == 0x20)
    starts[ws - spaced] = True
    gs, ge = s[~word], e[~word]
    closed = edge[ge]
    blank_last = b[ge - 1] == 0x20
    long = ge - gs >= 2
    starts[gs[closed | long | ~blank_last]] = True
    starts[(ge - 1)[~closed & long & ~blank_last]] = True
    marks = s[(kind == OTHER) & (e - s == 1)]
    marks = marks[(b[marks] == 0x27) & starts[marks]]
    if len(marks):
        stop = text_at[np.searchsorted(text_at, marks, side="right")]
        for m, z in zip(marks.tolist(), stop.tolist(), strict=True):
            tail = b[m + 1 : min(z, m + 3)].tobytes()
            if end := next((x for x in ENDINGS if tail.startswith(x)), None):
                starts[m + 1] = False
                if m + 1 + len(end) < z:
                    starts[m + 1 + len(end)] = True
    return np.flatnonzero(starts[:-1]), sure


class BlockEncoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        #: Known pre-tokens: hashes in ascending order, where each one's ids begin in ids, and how many there are.
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words (none known yet) with their ids; hashes ascend."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        cut = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, cut[:-1] + len(self.ids))
        self.size = np.insert(self.size, at, np.diff(cut))
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])

    def _places(self, hashes: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Where each of distinct, ascending hashes stands in known, after those that are missing were added."""
        at = np.searchsorted(self.known, hashes)
        there = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == hashes[inside]
        missing = np.flatnonzero(~there)
        if len(missing) and len(self.known) > CACHE_ENTRIES:
            self.clear()
            missing = np.arange(len(hashes))
        if len(missing):
            self._learn(hashes[missing], words(missing))
            at = np.searchsorted(self.known, hashes)
        return at

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column without nulls, uint32, and where each text's begin (one more at the end)."""
        b, text_at = raw_bytes(col)
        s, sure = token_starts(b, text_at)
        data = b.tobytes()
        for special in self.specials:
            at = data.find(special)
            while at >= 0:
                sure[np.searchsorted(text_at, at, side="right") - 1] = False
                at = data.find(special, at + 1)
        if not sure.all():
            s = s[sure[np.searchsorted(text_at, s, side="right") - 1]]
        ids = np.zeros(0, np.uint32)
        if len(s):
            up, down = powers(len(b))
            value = BYTE_VALUE[b]
            value *= up
            if sure.all():
                ends = np.append(s[1:], len(b))
                total = np.add.reduceat(value, s)
            else:
                ends = np.minimum(np.append(s[1:], len(b)), text_at[np.searchsorted(text_at, s, side="right")])
                total = np.add.reduceat(np.append(value, np.uint64(0)), np.column_stack([s, ends]).ravel())[::2]
            total *= down[s]
            total += (ends - s).astype(np.uint64)
            codes, uniques = pd.factorize(mix64(total))
            first = np.zeros(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            order = np.argsort(uniques)

            def words(which: np.ndarray) -> list[str]:
                at = first[order[which]]
                return [data[x:z].decode() for x, z in zip(s[at].tolist(), ends[at].tolist(), strict=True)]

            place = np.empty(len(uniques), np.int64)
            place[order] = self._places(uniques[order], words)
            begin, size = self.begin[place], self.size[place]
            lens = size[codes]
            done = np.zeros(len(lens) + 1, np.int64)
            np.cumsum(lens, out=done[1:])
            index = np.repeat(begin[codes] - done[:-1], lens)
            index += np.arange(done[-1])
            ids = self.ids[index]
            cut = done[np.searchsorted(s, text_at)]
        else:
            cut = np.zeros(len(text_at), np.int64)
        if sure.all():
            return ids, cut
        parts, at = [], 0
        for i, ok in enumerate(sure.tolist()):
            parts.append(ids[cut[i] : cut[i + 1]] if ok else self.whole(data[text_at[i] : text_at[i + 1]].decode()))
        lens = np.array([len(x) for x in parts])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BlockEncoder:
    """One encoder, with its cache, for each worker."""
    return BlockEncoder(path)


cache("tokens", encoder.cache_clear)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text, and where each text's begin."""
    return np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first))
