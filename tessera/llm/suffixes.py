"""Suffix-array dedup with a sparse suffix array.

Of the suffixes of all texts, those that begin at minimisers are kept: at the place with the smallest hash among each run of k-grams, a
choice made by content, so that any passage of MIN_WORDS words holds the same suffix starts wherever it stands. Suffixes are brought together
by their first k words. Where just two have them, they are compared. Where more have them, as with a frequent line, each window of MIN_WORDS
words around such a suffix is sorted by its hash, across range partitions that may cut through a group of equal windows, and compared with
the first of its group, the one in the document with the smallest id; the last window of a partition meets the first of the next. So no
number of other holders of a line comes between two documents that share more. Pairs on one diagonal of two documents make one candidate,
whose words are then compared and extended to the left and right as far as they agree.

Texts' words are dealt by id once, so that no later join moves them; only the slices that are compared move.

Ids are whole numbers. Defined results: null, empty and short texts have no passage; null ids take no part; repeated rows of an id are one document; passages
within one document don't count; a stretch that repeats itself with a period of up to 8 words is matched if it begins in the passage;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, blocks, bucketed, long_id, materialise, scratch, settle, tune
from .words import binary_slices
from .wordscan import Words, gram_hashes, inside, mix64

#: Shortest passage, in words, and words in the k-grams that suffixes are chosen and first sorted by.
MIN_WORDS, K = 50, 16
PERIOD = 8
#: Windows of a group that are compared with one of them.
CHUNK = 512
#: Tasks over which a key that many suffixes share is dealt in a join.
SALTS = 32
#: Columns that remove_passages adds for a while: no table is likely to have them.
SPANS, SPANS_OF = "__tessera_spans", "__tessera_spans_of"


def minimisers(h: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost smallest hash of each `width` consecutive k-grams of one text. text ascends: each k-gram's text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, at, span = h, np.arange(len(h)), 1
    while span * 2 <= width:
        right = value[span:] < value[:-span]
        at = np.where(right, at[span:], at[:-span])
        value = np.where(right, value[span:], value[:-span])
        span *= 2
    shift = width - span
    if shift:
        at = np.where(value[shift:] < value[:-shift], at[shift:], at[:-shift])
    return np.unique(at[:n][text[:n] == text[width - 1 :]])


def suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """For each text of at least min_words words: id, words (binary, uint32), and its chosen suffixes' key (hash of their
    first k words) and pos, as lists."""
    tune(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).where("id is not null")
    width = min_words - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for block in blocks(batches, "_text"):
            w = Words(block.column("_text"))
            wide = mix64(w.hash.astype(np.uint32).astype(np.uint64))
            whole = gram_hashes(wide, k)
            ok = inside(w.first, k, len(w))
            at = np.flatnonzero(ok)
            h = whole[at]
            text = np.searchsorted(w.first, at, side="right") - 1
            fresh = np.ones(len(h), bool)
            for p in range(1, PERIOD + 1):
                fresh[p:] &= (h[p:] != h[:-p]) | (text[p:] != text[:-p])
            # in a stretch that repeats itself, its begin and every width-th place from there
            index = np.arange(len(h))
            fresh |= (index - np.maximum.accumulate(np.where(fresh, index, 0))) % width == 0
            chosen = minimisers(h, text, width)
            chosen = chosen[fresh[chosen]]
            pos, of = at[chosen], text[chosen]
            first = np.searchsorted(of, np.arange(len(w.first)))
            long = np.flatnonzero(np.diff(w.first) >= min_words)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (h[chosen].view(np.int64), (pos - w.first[of]).astype(np.int32))]
            out = pa.RecordBatch.from_arrays([block.column("id"), binary_slices(w.hash.astype(np.uint32), w.first), *lists], ["id", "words", "key", "pos"])
            yield out.take(pa.array(long))

    return rows.mapInArrow(run, "id bigint, words binary, key array<bigint>, pos array<int>")


_LINK = "kind int, part int, key bigint, a bigint, a_pos int, b bigint, b_pos int"


def neighbours(rows: DataFrame, partitions: int, chunk: int = CHUNK) -> DataFrame:
    """Sorts windows (key, id, pos). kind 0: a window (a, a_pos) and the first (b, b_pos) of its run of up to chunk windows of a group, of another
    document; the first of a run meets that of the run before. kind 1 and 2: the first window of each partition, and the first of its last run."""
    order = ["key", "id", "pos"]
    ranged = rows.select(*order).repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        part = TaskContext.get().partitionId()
        begun, at_key, seen, lead = False, 0, 0, (0, 0)

        def rows_of(kind: int, key: np.ndarray, a: np.ndarray, ap: np.ndarray, b: np.ndarray, bp: np.ndarray) -> pa.RecordBatch:
            n = len(key)
            cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(key), pa.array(a), pa.array(ap.astype(np.int32)), pa.array(b), pa.array(bp.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, ["kind", "part", "key", "a", "a_pos", "b", "b_pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, pos = (batch.column(c).to_numpy().astype(np.int64) for c in order)
            if not begun:
                begun, at_key = True, int(key[0])
                yield rows_of(1, key[:1], ids[:1], pos[:1], ids[:1], pos[:1])
            index = np.arange(len(key))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = int(key[0]) != at_key
            start = np.maximum.accumulate(np.where(new, index, -1))
            place = np.where(start < 0, index + seen, index - start)  # in the group
            first = np.maximum.accumulate(np.where(place % chunk == 0, index, -1))
            lead_id, lead_pos = np.where(first < 0, lead[0], ids[first]), np.where(first < 0, lead[1], pos[first])
            # the first of a run meets that of the run before it
            again = np.flatnonzero((first == index) & (place > 0))
            before = again - 1
            b, bp = lead_id.copy(), lead_pos.copy()
            b[again], bp[again] = np.where(before < 0, lead[0], lead_id[before]), np.where(before < 0, lead[1], lead_pos[before])
            near = np.flatnonzero(b != ids)
            yield rows_of(0, key[near], ids[near], pos[near], b[near], bp[near])
            at_key, seen, lead = int(key[-1]), int(place[-1]) + 1, (int(lead_id[-1]), int(lead_pos[-1]))
        if begun:
            b, bp = np.array([lead[0]]), np.array([lead[1]])
            yield rows_of(2, np.array([at_key]), b, bp, b, bp)

    return ranged.mapInArrow(run, _LINK)


def _across(links: DataFrame) -> DataFrame:
    """Links between the last suffixes of a partition and the first of the next one that has any: two rows a partition are looked at."""
    edges = links.where("kind > 0").groupBy("part").agg(
        *(F.max(F.when(F.col("kind") == kind, F.struct("key", "a", "a_pos", "b", "b_pos"))).alias(name) for kind, name in ((1, "head"), (2, "tail")))
    )
    met = edges.select("head", F.lag("tail").over(Window.orderBy("part")).alias("tail")).where("head.key = tail.key")
    return met.select("head.a", "head.a_pos", F.col("tail.a").alias("b"), F.col("tail.a_pos").alias("b_pos")).where("a <> b")


def windows(texts: DataFrame, min_words: int, k: int) -> DataFrame:
    """key (hash), id and pos of each window of min_words words that holds a suffix of the list `at`, for texts (id, words, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for i, words, at in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist(), batch.column("at").to_pylist(), strict=True):
                h = gram_hashes(mix64(np.frombuffer(words, np.uint32).astype(np.uint64)), min_words)
                covered = np.zeros(len(h) + 1, np.int64)
                hi = np.minimum(np.array(at, np.int64), len(h) - 1) + 1
                np.add.at(covered, np.minimum(np.maximum(np.array(at, np.int64) - (min_words - k), 0), len(h)), 1)
                np.add.at(covered, hi, -1)
                pos = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[pos].view(np.int64)), pa.array(np.full(len(pos), i, np.int64)), pa.array(pos.astype(np.int32))], ["key", "id", "pos"])

    return texts.mapInArrow(run, "key bigint, id bigint, pos int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """Passages of at least min_words words that stand in two documents: id, first_word, n_words, other_id (smaller), other_first_word. Every
    document that shares a passage with others is tied to one of them; pairs that follow from others are not listed."""
    spark = docs.sparkSession
    with scratch(spark):
        return materialise(_passages(docs, id_col, text_col, min_words, k), "passages", keep=True)


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(suffixes(docs, id_col, text_col, min_words, k).repartition(parts, "id"), "suffixes", "id")
    rows = texts.select("id", F.explode(F.arrays_zip("key", "pos")).alias("s")).select("s.key", "id", "s.pos")
    place = F.struct("id", "pos")
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y")).where("n > 1 and x.id <> y.id"), "keys")
    two = keys.where("n = 2").select(F.col("y.id").alias("a"), F.col("y.pos").alias("a_pos"), F.col("x.id").alias("b"), F.col("x.pos").alias("b_pos"))
    # a key that many suffixes share is dealt over some tasks
    salts = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt")
    many = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(keys.where("n > 2").select("key", salts), ["key", "salt"], "left_semi")
    at = many.groupBy("id").agg(F.collect_set("pos").alias("at"))
    found = materialise(windows(texts.select("id", "words").join(at, "id"), min_words, k), "windows")
    with batch_rows(spark, 65_536):
        links = materialise(neighbours(found, parts), "links")
    whole = links.where("kind = 0").select("a", "a_pos", "b", "b_pos").unionByName(_across(links))
    both = two.unionByName(whole)
    later = F.col("a") > F.col("b")
    both = both.select(
        F.greatest("a", "b").alias("a"),
        F.least("a", "b").alias("b"),
        F.when(later, F.col("a_pos")).otherwise(F.col("b_pos")).alias("a_pos"),
        F.when(later, F.col("b_pos")).otherwise(F.col("a_pos")).alias("b_pos"),
    )
    runs = both.groupBy("a", "b", (F.col("a_pos") - F.col("b_pos")).alias("shift")).agg(F.min("a_pos").alias("lo"), F.max("a_pos").alias("hi"))
    runs = runs.withColumn("a_at", F.greatest(F.col("lo") - min_words, F.col("shift"), F.lit(0))).withColumn("size", F.col("hi") + k + min_words - F.col("a_at"))
    runs = runs.withColumn("b_at", F.col("a_at") - F.col("shift"))
    of = lambda x: texts.select(F.col("id").alias(x), "words")
    cut = lambda at: F.expr(f"substring(words, {at} * 4 + 1, size * 4)")
    runs = runs.join(of("b"), "b").select("a", "b", "a_at", "b_at", "size", cut("b_at").alias("b_words"))
    runs = runs.join(of("a"), "a").select("a", "b", "a_at", "b_at", cut("a_at").alias("a_words"), "b_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "a_at", "b_at", "a_words", "b_words")]
            for a, b, a_at, b_at, x, y in zip(*cols, strict=True):
                n = min(len(x), len(y)) // 4
                same = np.frombuffer(x, np.uint32, n) == np.frombuffer(y, np.uint32, n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                for lo, hi in edge.reshape(-1, 2).tolist():
                    if hi - lo >= min_words:
                        out.append((a, a_at + lo, hi - lo, b, b_at + lo))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "first_word", "n_words", "other_id", "other_first_word"])

    found = runs.mapInArrow(run, "id bigint, first_word bigint, n_words bigint, other_id bigint, other_first_word bigint").distinct()
    return found.withColumnsRenamed({"id": id_col, "other_id": f"other_{id_col}"})


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False) -> DataFrame:
    """docs without the passages listed for them (those of repeated_passages: the copy with the smallest id stays). A text's other words, and
    what stands between them, are kept; columns are those of docs. A document of which no word is left goes if drop_empty."""
    spans = passages.groupBy(F.col(id_col).alias(SPANS_OF)).agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias(SPANS))
    joined = docs.join(spans.hint("merge"), docs[id_col] == F.col(SPANS_OF), "left").drop(SPANS_OF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, spans = batch.column(at), batch.column(SPANS)
            batch = batch.drop_columns([SPANS])
            hit = np.flatnonzero(np.array([bool(x.as_py()) for x in spans.is_valid()]))
            if len(hit):
                new = texts.to_pylist()
                left = np.ones(len(new), bool)
                for i in hit.tolist():
                    new[i] = _without(texts[i].as_py(), [(s["first_word"], s["n_words"]) for s in spans[i].as_py()])
                    left[i] = not drop_empty or len(Words(pa.array([new[i]]), hashed=False)) > 0
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).filter(pa.array(left))
            yield batch

    return joined.mapInArrow(run, docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    w = Words(pa.array([text]), hashed=False)
    raw, out, at = text.encode(), [], 0
    for first, n in spans:
        lo, hi = int(w.start[first]), int(w.end[first + n - 1])
        if lo > at:
            out.append(raw[at:lo])
        at = max(at, hi)
    out.append(raw[at:])
    return b"".join(out).decode()


__all__ = ["minimisers", "neighbours", "remove_passages", "repeated_passages", "suffixes"]
