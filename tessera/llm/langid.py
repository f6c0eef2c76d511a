"""Language identification with language-bitmask n-gram filters.

For each language the n-grams (of lower-cased bytes; every run of other bytes is one space) that are frequent in its training texts go
into a Bloom filter. The filters are bit-sliced: one slot holds a bit for each language, so k look-ups and an AND return all languages
that may hold an n-gram. A text's n-grams are looked up, bits are counted for each language, and each count is corrected for the
filter's false positives: with f the chance that a missing n-gram is reported, (seen/n - f) / (1 - f) estimates the share held.

Counts come from all training rows. Filters have a fixed size whatever the corpus. Defined results: null text or one without a letter
gives `und` and score 0, as does any text if no language was learned; repeated rows get the same answer; ties go to the language that
sorts first; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, settle, tune
from .license_scan import joined_words
from .wordscan import Words, mix64

#: Bytes in an n-gram.
N = 3
#: An n-gram belongs to a language if it makes up this share of the language's n-grams ...
MIN_RATE = 5e-5
#: ... and at least this part of the largest such share in any language.
MIN_PART = 0.2
#: Slots of the filter, a power of two, and look-ups for an n-gram.
SLOTS, LOOKUPS = 1 << 20, 3


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept for testing; one without an id isn't (nor is it learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a block's texts, and where each text's begin (one more at the end). A text starts and ends with a space."""
    joined, place = joined_words(w)
    data = np.frombuffer(b" " + joined, np.uint8).astype(np.uint32)
    data[data == 10] = 32
    # text i is data[at[i] : at[i + 1] + 1]: from the space before its first word to the one after its last
    at = place[w.first]
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    n = np.maximum(np.diff(at) - N + 2, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], n)
    return code[index], first


class LanguageFilter:
    """Bit-sliced Bloom filters of some languages. bits[slot] holds a bit for each language."""

    def __init__(self, languages: list[str], slots: int = SLOTS, lookups: int = LOOKUPS) -> None:
        self.languages, self.slots, self.lookups = languages, slots, lookups
        self.bits = np.zeros((slots, -(-len(languages) // 8)), np.uint8)

    def _slots(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(codes.astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.lookups):
            yield ((h + np.uint64(i) * step) & np.uint64(self.slots - 1)).astype(np.int64)

    def add(self, language: int, codes: np.ndarray) -> None:
        for at in self._slots(codes):
            self.bits[at, language // 8] |= np.uint8(128 >> language % 8)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """A bit mask (bytes) of the languages that may hold each n-gram."""
        out = np.full((len(codes), self.bits.shape[1]), 255, np.uint8)
        for at in self._slots(codes):
            out &= self.bits[at]
        return out

    def false_positives(self) -> np.ndarray:
        fill = np.unpackbits(self.bits, axis=1, count=len(self.languages)).mean(axis=0)
        return fill**self.lookups

    def shares(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text, the corrected share of its n-grams that each language holds."""
        masks = self.lookup(codes)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (masks[:, k // 8] >> np.uint8(7 - k % 8)) & np.uint8(1)
            total = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            out[:, k] = total[first[1:]] - total[first[:-1]]
        f = self.false_positives()
        return np.clip((out / np.maximum(n, 1)[:, None] - f) / np.maximum(1 - f, 1e-9), 0, 1) * (n > 0)[:, None]


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram, n: how often each language's texts hold each n-gram. Each task adds up its own texts first."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text")).where("lang is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = folded(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(n)], ["lang", "gram", "n"])

        for block in blocks(batches, "_text", 4 << 20):
            codes, first = grams(Words(block.column("_text"), hashed=False))
            langs = np.array(block.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(len(langs)), np.diff(first))
            for lang in set(langs):
                got = codes[(langs == lang)[row]]
                # n-grams are 24-bit numbers: one pass counts them
                n = np.bincount(got, minlength=1)
                there = np.flatnonzero(n)
                held.setdefault(lang, []).append((there, n[there]))
                size += len(there)
            if size > 2_000_000:
                held = {lang: [folded(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1_000_000:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    return rows.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageFilter:
    """Fits the filters on all of docs. What reaches the driver is at most 1 / MIN_RATE n-grams a language."""
    counts = count_grams(docs, lang_col, text_col)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= MIN_RATE)
    top = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    rows = top.select("gram", F.explode("of").alias("x"), "most").where(F.col("x.rate") >= MIN_PART * F.col("most")).select("x.lang", "gram").toPandas()
    out = LanguageFilter(sorted(rows["lang"].unique().tolist()))
    for k, lang in enumerate(out.languages):
        out.add(k, rows.loc[rows["lang"] == lang, "gram"].to_numpy())
    return out


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id, lang_pred, score (the best language's share of all shares) and shares (language to corrected share)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bytes for each 8 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for block in blocks(batches, "_text"):
            col = block.column("_text")
            w = Words(col, hashed=False)
            shares = model.shares(*grams(w)) if model.languages else np.zeros((len(col), 1))
            letters = np.add.reduceat(np.append((w.data >= 97) & (w.data <= 122), False).astype(np.int64), w.text_at[:-1]) * (np.diff(w.text_at) > 0)
            best, most = shares.argmax(axis=1), shares.max(axis=1)
            best[most <= 0] = 0
            lettered = letters > 0
            for i in np.flatnonzero(~lettered).tolist():
                lettered[i] = any(ch.isalpha() for ch in col[i].as_py())
            known = lettered & bool(model.languages)
            score = np.where(known & (most > 0), most / np.maximum(shares.sum(axis=1), 1e-12), 0.0)
            pred = names[np.where(known, best, len(model.languages))]
            maps = [list(zip(model.languages, x, strict=True)) if model.languages else [] for x in shares.tolist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("_id"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                [id_col, "lang_pred", "score", "shares"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, shares map<string,double>")
