"""License scans: exact phrases, and short notices found within an edit bound.

A notice of m characters may differ by up to e edits. Cut into e + 1 pieces, at least one piece of any such occurrence is unedited
(pigeonhole), so a plain byte search for the pieces finds every place that can match. Around each such place the `regex` library's
bounded-error matching verifies the edits and reports the span.

Defined results: null text counts as empty; an empty text has no words, no labels, score 0; a repeated row is scanned like any other;
columns beyond the id and text are not read. Texts are scanned whole, one Arrow block at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, settle, tune
from .wordscan import Words, word_hash

#: Phrases of consecutive words, and the label each gives. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices (words joined by one space) and their labels: the method's own labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "under the terms of the gnu general public license": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "released under the mit license": "mit-notice",
    "creative commons attribution": "cc-notice",
    "spdx license identifier": "spdx-notice",
    "all rights reserved": "rights-reserved",
}

#: Edits allowed for a notice: one for each so many characters.
CHARS_PER_EDIT = 12

SPAN = "struct<label:string,first_word:bigint,last_word:bigint,edits:int>"


class Notice:
    def __init__(self, text: str, label: str) -> None:
        self.text, self.label = text.encode(), label
        self.edits = len(text) // CHARS_PER_EDIT
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        #: (offset, piece)
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?<![^ \\n])(?:" + regex.escape(self.text, special_only=True) + b"){i<=%d,d<=%d,s<=%d,e<=%d}(?![^ \\n])" % ((self.edits,) * 4), regex.BESTMATCH)

    def occurrences(self, joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of every occurrence in texts whose words are joined by one space and which end in a new line."""
        slack, seen, found = self.edits, set(), {}
        for offset, piece in self.pieces:
            at = joined.find(piece)
            while at >= 0:
                lo = max(0, joined.rfind(b"\n", 0, at) + 1, at - offset - slack - 1)
                stop = joined.find(b"\n", at)
                hi = min(stop if stop >= 0 else len(joined), at - offset + len(self.text) + slack + 1)
                if (lo, hi) not in seen:
                    seen.add((lo, hi))
                    # endpos hides what follows; look-arounds still see what lies before lo, a new line where another text ends there.
                    if m := self.pattern.search(joined, lo, hi if hi == stop else hi + 1):
                        found[m.start()] = (m.start(), m.end(), sum(m.fuzzy_counts))
                at = joined.find(piece, at + 1)
        out: list[tuple[int, int, int]] = []
        for x in sorted(found.values(), key=lambda x: (x[2], x[0])):
            if all(x[1] <= y[0] or x[0] >= y[1] for y in out):
                out.append(x)
        return sorted(out)


@functools.lru_cache(maxsize=8)
def _notices(items: tuple[tuple[str, str], ...]) -> list[Notice]:
    return [Notice(t, label) for t, label in items]


def joined_words(w: Words) -> tuple[bytes, np.ndarray]:
    """All words, one space after each (a new line after the last of a text), and the place of each word there."""
    size = w.end - w.start + 1
    at = np.zeros(len(w) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.full(int(at[-1]), 32, np.uint8)
    keep = np.flatnonzero(w.is_word)
    if len(keep):
        word_no = np.repeat(np.arange(len(w)), w.end - w.start)
        out[keep - w.start[word_no] + at[word_no]] = w.data[keep]
    last = w.first[1:][np.diff(w.first) > 0]
    out[at[last] - 1] = 10
    return out.tobytes(), at


def _scan(col: pa.Array, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> dict[str, list | np.ndarray]:
    w = Words(col)
    n = len(col)
    n_words = np.diff(w.first)
    n_base, lo, hi = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    base: list[set[str]] = [set() for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for phrase, label in phrases:
        hs = [np.uint64(word_hash(x)) for x in phrase.split()]
        k = len(hs)
        at = np.flatnonzero(w.hash[: max(0, len(w) - k + 1)] == hs[0])
        for j in range(1, k):
            at = at[w.hash[at + j] == hs[j]]
        doc = np.searchsorted(w.first, at, side="right") - 1
        ok = at + k <= w.first[doc + 1]
        for d, i in zip(doc[ok].tolist(), (at[ok] - w.first[doc[ok]]).tolist(), strict=True):
            n_base[d] += 1
            lo[d] = i if lo[d] < 0 else min(lo[d], i)
            hi[d] = max(hi[d], i)
            base[d].add(label)
            spans[d].append({"label": label, "first_word": i, "last_word": i + k - 1, "edits": 0})
    score = (n_base > 0).astype(float)
    labels = [set(x) for x in base]
    joined, place = joined_words(w)
    for notice in _notices(notices):
        for a, b, edits in notice.occurrences(joined):
            i = int(np.searchsorted(place, a, side="right")) - 1
            j = int(np.searchsorted(place, b - 1, side="right")) - 1
            d = int(np.searchsorted(w.first, i, side="right")) - 1
            labels[d].add(notice.label)
            score[d] = max(score[d], 1 - edits / len(notice.text))
            spans[d].append({"label": notice.label, "first_word": i - int(w.first[d]), "last_word": j - int(w.first[d]), "edits": edits})
    text = lambda sets: [",".join(sorted(x)) for x in sets]
    none = n_base == 0
    return {
        "n_words": n_words,
        "n_base": n_base,
        "first_word": pa.array(lo, mask=none),
        "last_word": pa.array(hi, mask=none),
        "base_labels": text(base),
        "labels": text(labels),
        "score": score,
        "spans": [sorted(x, key=lambda s: (s["first_word"], s["label"])) for x in spans],
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each of docs: id, n_words, n_base (places of the phrases), first_word, last_word (smallest and largest start),
    base_labels, labels, score, spans (label, first_word, last_word, edits)."""
    tune(docs.sparkSession)
    p = tuple(sorted((PHRASES if phrases is None else phrases).items()))
    q = tuple(sorted((NOTICES if notices is None else notices).items()))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
        for block in blocks(batches, "_text"):
            out = _scan(block.column("_text"), p, q)
            spans = pa.array(out.pop("spans"), kind)
            yield pa.RecordBatch.from_arrays([block.column("_id"), *(pa.array(x) for x in out.values()), spans], [id_col, *out, "spans"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<{SPAN}>")
