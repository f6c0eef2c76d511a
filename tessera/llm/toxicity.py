"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

Lexicon. Terms are learned from labelled texts: whole words, and stems (prefixes shared by many forms), that stand in toxic texts and
hardly in others. They form one trie. For a word, the automaton follows the trie with every set of (trie node, edits so far) reachable
within the term's edit bound; sets of states are made once and kept, so a word costs one look-up a character and most words end after a
few. Exact and stem matches and misspelled ones are told apart.

Context. Each match is scored in a window: inside quotation marks, or near a word that reports speech or talks about the word itself,
it counts as quoted. A logistic model over counts of exact, misspelled and quoted matches, and over their density, gives the score.

Defined results: null and empty texts have no match and get the score of such texts; repeated rows score alike; without usable labels
(none, or of one class) the score is that class's share, 0 if there is none; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cache, drop, materialise, settle, tune
from .langid import held_out
from .wordscan import Words

#: Labelled rows to fit on, about; all if there are fewer. The sample is drawn by a hash of the id.
FIT_ROWS = 20_000
#: Shortest stem and longest, in characters.
STEM = (4, 12)
#: A term stands in at least so many toxic texts of the sample, and of the texts that hold it at least so large a part is toxic.
MIN_TOXIC, MIN_PART = 4, 0.9
#: Words on either side of a match that are its context.
WINDOW = 6
#: Characters of a term from which one edit, and two, are allowed.
EDITS = (5, 10)

#: Pairs of quotation marks. Fixed values.
QUOTES = (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“"), ("„", "”"))
#: Words of reported speech or of talk about words. Fixed values.
CUES = (
    "said says wrote called quoted quote word words term insult slur "
    "dit mot terme cita palabra dijo insulto sagte wort zitat begriff beleidigung"
).split()

#: A quotation: from a mark to the next one that ends it, in one paragraph.
_QUOTED = re.compile("|".join(f"{a}(?:(?!{b}|\\n\\s*\\n).)*{b}" for a, b in QUOTES).encode(), re.S)

EXACT, FUZZY = 1, 2


@dataclass
class Lexicon:
    """words: whole terms; stems: prefixes whose every continuation counts."""

    words: list[str]
    stems: list[str]
    _next: list[dict[str, int]] = field(default_factory=list, repr=False)
    _term: list[int] = field(default_factory=list, repr=False)  # edits allowed + 1 where a word ends
    _stem: list[bool] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self._next, self._term, self._stem = [{}], [0], [False]
        for term, stem in [*((w, False) for w in self.words), *((s, True) for s in self.stems)]:
            node = 0
            for ch in term:
                if ch not in self._next[node]:
                    self._next[node][ch] = len(self._next)
                    self._next.append({})
                    self._term.append(0)
                    self._stem.append(False)
                node = self._next[node][ch]
            if stem:
                self._stem[node] = True
            else:
                self._term[node] = 1 + sum(len(term) >= n for n in EDITS)
        self._most = max([0, *(t - 1 for t in self._term)])
        below = [0] * len(self._next)  # the largest bound of the words under a node
        for node in range(len(self._next) - 1, -1, -1):
            below[node] = max([self._term[node], *(below[x] for x in self._next[node].values())])
        self._below = below
        self._clear()

    def _clear(self) -> None:
        self._sets: dict[frozenset, int] = {}
        self._moves: list[dict[str, int]] = []
        self._states: list[frozenset] = []
        self._accept: list[int] = []
        self._start = self._state({(0, 0)})

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems}

    def __setstate__(self, x: dict) -> None:
        self.__init__(**x)

    def _state(self, members: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits); terms' missing letters are skipped here. -1 is the empty set."""
        best: dict[int, int] = {}
        todo = sorted(members, key=lambda x: -x[1])
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e or e and e >= self._below[node]:
                continue
            best[node] = e
            if e < self._most:
                todo += [(x, e + 1) for x in self._next[node].values()]
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self._sets:
            self._sets[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
            accept = [EXACT if e == 0 else FUZZY for node, e in key if e < self._term[node]]
            self._accept.append(min(accept, default=0))
        return self._sets[key]

    def _move(self, state: int, ch: str) -> int:
        """The state after ch, -2 where a stem is complete."""
        members: set[tuple[int, int]] = set()
        for node, e in self._states[state]:
            step = self._next[node].get(ch)
            if step is not None:
                if e == 0 and self._stem[step]:
                    return -2
                members.add((step, e))
            if e < self._most:
                members.add((node, e + 1))  # a letter too many
                members.update((x, e + 1) for x in self._next[node].values())  # another letter
        return self._state(members)

    def match(self, word: str) -> int:
        """EXACT for a term or a word that begins with a stem, FUZZY for one within the edit bound of a term, else 0."""
        if len(self._states) > 50_000:
            self._clear()
        state = self._start
        for ch in word:
            move = self._moves[state].get(ch)
            if move is None:
                move = self._moves[state][ch] = self._move(state, ch)
            if move < 0:
                return EXACT if move == -2 else 0
            state = move
        return self._accept[state]


_cache: dict[bytes, int] = {}
_cache_of: tuple = ()


def _clear() -> None:
    global _cache, _cache_of
    _cache, _cache_of = {}, ()


cache("toxicity", _clear)


def _kinds(w: Words, lexicon: Lexicon) -> np.ndarray:
    """The kind of match of each word of a block. Each distinct word is looked up once."""
    import pandas as pd

    global _cache, _cache_of
    if _cache_of != (key := (tuple(lexicon.words), tuple(lexicon.stems))) or len(_cache) > 200_000:
        _cache, _cache_of = {}, key
    codes, uniques = pd.factorize(w.hash)
    first = np.zeros(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    kinds = np.zeros(len(uniques), np.int8)
    data, known, match = w.data.tobytes(), _cache, lexicon.match
    for k, (h, a, b) in enumerate(zip(uniques.tolist(), w.start[first].tolist(), w.end[first].tolist(), strict=True)):
        kind = known.get(h)
        if kind is None:
            kind = known[h] = match(data[a:b].decode(errors="replace"))
        kinds[k] = kind
    return kinds[codes]


FEATURES = ("n_exact", "n_fuzzy", "n_quoted", "n_words")


def _features(block_text: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """For each text: abusive exact matches, abusive misspelled ones, quoted ones, words."""
    w = Words(block_text)
    out = np.zeros((len(block_text), 4), np.int64)
    out[:, 3] = np.diff(w.first)
    if not len(w):
        return out
    kinds = _kinds(w, lexicon)
    hits = np.flatnonzero(kinds)
    cues = set(CUES)
    data = w.data.tobytes() if len(hits) else b""
    docs = np.searchsorted(w.first, hits, side="right") - 1
    at, ends = -1, np.zeros(0, np.int64)
    for i, d in zip(hits.tolist(), docs.tolist(), strict=True):
        if d != at:
            at = d
            ends = np.array([x + int(w.text_at[d]) for m in _QUOTED.finditer(data[w.text_at[d] : w.text_at[d + 1]]) for x in m.span()], np.int64)
        lo, hi = max(int(w.first[d]), i - WINDOW), min(int(w.first[d + 1]), i + WINDOW + 1)
        quoted = np.searchsorted(ends, int(w.start[i]), side="right") % 2 == 1  # between the two ends of a quotation
        quoted = quoted or any(w.word(j).decode(errors="replace") in cues for j in range(lo, hi) if j != i)
        out[d, 2 if quoted else kinds[i] - 1] += 1
    return out


def term_counts(rows: DataFrame) -> DataFrame:
    """term, stem, n_toxic, n_clean: in how many texts (of `_text`, `toxic`) each word and each prefix of a longer word stands outside
    of quotation marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("toxicity")
        counts: dict[tuple[str, bool], list[int]] = {}
        for block in blocks(batches, "_text"):
            w = Words(pa.array([_QUOTED.sub(b" ", t.encode()).decode() for t in block.column("_text").to_pylist()], pa.string()), hashed=False)
            data = w.data.tobytes()
            for d, toxic in enumerate(block.column("toxic").to_pylist()):
                seen: set[tuple[str, bool]] = set()
                a, b = int(w.first[d]), int(w.first[d + 1])
                for word in {data[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)}:
                    word = word.decode(errors="replace")
                    seen.add((word, False))
                    seen.update((word[:n], True) for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))
                for key in seen:
                    counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
            if len(counts) > 500_000:
                yield _count_rows(counts)
                counts = {}
        if counts:
            yield _count_rows(counts)

    def _count_rows(counts: dict) -> pa.RecordBatch:
        terms, stems = zip(*counts, strict=True)
        a, b = zip(*counts.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(stems), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["term", "stem", "n_toxic", "n_clean"])

    made = rows.mapInArrow(run, "term string, stem boolean, n_toxic bigint, n_clean bigint")
    return made.groupBy("term", "stem").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled rows (`_text`, `toxic` 0/1). Stems that another stem begins are left out. Terms number at most the words of the sample
    that stand in MIN_TOXIC of its toxic texts, which fit_rows bounds."""
    counts = materialise(term_counts(rows), "terms")
    n_toxic = rows.where("toxic = 1").count()
    base = min(max(n_toxic / max(rows.count(), 1), 1e-6), 1 - 1e-6)
    t, c = F.col("n_toxic"), F.col("n_clean")
    part = t / (t + c)
    # the log-likelihood that a term's own share gains over the base share must beat what chance gives among so many terms
    gain = t * F.log(part / base) + F.when(c > 0, c * F.log((1 - part) / (1 - base))).otherwise(0.0)
    tested = counts.where(t >= MIN_TOXIC)
    good = tested.where((part >= MIN_PART) & (gain >= math.log(max(tested.count(), 1)) + 2))
    found = good.orderBy("term").collect()
    drop(counts)
    whole = {r["term"]: r["n_toxic"] for r in found if not r["stem"]}
    # A prefix is a stem if texts hold several of its forms: more texts than any one longer form has.
    stems: list[str] = []
    for r in found:
        if r["stem"] and not any(r["term"].startswith(s) for s in stems[-1:]):
            inner = max((n for t, n in whole.items() if t.startswith(r["term"])), default=0)
            if r["n_toxic"] > 1.2 * inner + 1:
                stems.append(r["term"])
    return Lexicon(sorted(t for t in whole if len(t) >= 3), stems)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(features) @ np.array(self.weights) + self.bias, -40, 40)))


def _inputs(features: np.ndarray) -> np.ndarray:
    f = features.astype(float)
    density = f[:, :2].sum(axis=1) / np.maximum(f[:, 3], 1)
    return np.column_stack([np.log1p(f[:, 0]), f[:, 0] > 0, np.log1p(f[:, 1]), np.log1p(f[:, 2]), np.minimum(50 * density, 5)])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def featurise(rows: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "_text") -> DataFrame:
    """keep's columns and the four counts for each row."""
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("toxicity")
        for block in blocks(batches, text_col):
            f = _features(block.column(text_col), lexicon)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *(pa.array(f[:, k]) for k in range(4))], [*keep, *FEATURES])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, kinds + "".join(f", {x} bigint" for x in FEATURES))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fits on the labelled rows that are not held out (crc32 of the id as text, mod 5, is not 0), or on about fit_rows of them."""
    tune(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(~held_out("_id"))
    if n > fit_rows:
        drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_rows / n))
        known, rows = known.where(drawn), rows.where(drawn)
    rows = rows.join(known, "_id").select("_text", "toxic")
    lexicon = learn_lexicon(rows)
    seen = featurise(rows, lexicon, ["toxic"]).toPandas()
    y = seen["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(lexicon, [0.0] * 5, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    return ToxicityModel(lexicon, *_fit(_inputs(seen[list(FEATURES)].to_numpy()), y))


def _score(model: ToxicityModel) -> Column:
    n = [F.col(x).cast("double") for x in FEATURES]
    inputs = [F.log1p(n[0]), (n[0] > 0).cast("double"), F.log1p(n[1]), F.log1p(n[2]), F.least(50 * (n[0] + n[1]) / F.greatest(n[3], F.lit(1.0)), F.lit(5.0))]
    total = F.lit(model.bias)
    for x, weight in zip(inputs, model.weights, strict=True):
        total = total + x * F.lit(weight)
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id, score (0 to 1), predicted (1 if score >= 0.5), and the counts behind it."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    score = _score(model)
    return featurise(rows, model.lexicon, [id_col]).select(id_col, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *FEATURES)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that score less than 0.5. Rows are judged as they pass, so nothing is joined or shuffled."""
    tune(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("toxicity")
        for batch in batches:
            at, part = 0, [batch.column(columns.index(text_col)), pa.array(np.arange(batch.num_rows))]
            for block in blocks(iter([pa.RecordBatch.from_arrays(part, ["_text", "row"])]), "_text"):
                clean = model.score(_features(block.column("_text"), model.lexicon)) < 0.5
                yield batch.slice(at, block.num_rows).filter(pa.array(clean))
                at += block.num_rows

    return docs.mapInArrow(run, docs.schema)


