"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each shard holds, for each of its terms, the ascending positions (over the shard's words) at
which the term stands, and the shard's documents with their first positions. Building needs no shuffle, and no list is longer than a
shard. A phrase of test words is looked up in each shard: the rarest term's list, moved back by the term's offset, gives the possible
starts; the other lists, moved likewise, are intersected with it from the next rarest on. Proximity search allows gaps between terms.

Defined results: null texts hold no words; an item of no words has no window; one of fewer words than a window is one window; a row
that occurs twice is reported twice; other columns are not read. Empty tables give empty results (no items: no hits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise, settle, tune
from .wordscan import Words

#: Words in a window of an item.
WINDOW = 8
#: A document with windows of so many items is contaminated.
MIN_ITEMS = 2
#: Bytes of text in a shard of the index.
SHARD_BYTES = 4 << 20
#: Windows that are searched in one pass over the index; more windows take more passes, so memory doesn't grow with the items.
PASS_WINDOWS = 100_000

#: Stands for a null id in the index.
NO_ID = -(1 << 63)

INDEX = "shard bigint, term bigint, positions binary, docs binary, firsts binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: one row for each term of a shard (term and positions, uint32), and one for the shard's documents (docs: ids,
    int64; firsts: each one's first position and the end, uint32)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        shard = TaskContext.get().partitionId() << 32
        for block in blocks(batches, "_text", shard_bytes):
            w = Words(block.column("_text"))
            yield _shard_rows(shard, pc.fill_null(block.column("_id"), NO_ID).to_numpy(), w.first, w.hash)
            shard += 1

    return materialise(rows.mapInArrow(run, INDEX), "index")  # shards are numbered by tasks, so they are made once


def _shard_rows(shard: int, ids: np.ndarray, first: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    codes, terms = pd.factorize(h)
    order = np.argsort(codes, kind="stable").astype(np.uint32)
    at = np.zeros(len(terms) + 1, np.int64)
    np.cumsum(np.bincount(codes, minlength=len(terms)), out=at[1:])
    n = len(terms) + 1
    # the last row is that of the documents
    valid = np.packbits(np.arange(n) < n - 1, bitorder="little").tobytes()
    offsets = (np.append(at, at[-1]) * 4).astype(np.int32)
    positions = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(order.tobytes())])
    term = pa.array(np.append(terms.astype(np.uint64), np.uint64(0)).view(np.int64), mask=np.arange(n) == n - 1)
    only = lambda x: pa.array([None] * (n - 1) + [x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, shard, np.int64)), term, positions, only(ids.astype(np.int64)), only(first.astype(np.uint32))],
        ["shard", "term", "positions", "docs", "firsts"],
    )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: terms (array of term hashes) and items (the ids, as strings, that have them)."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("_text")).where("item is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for block in blocks(batches, "_text"):
            w = Words(block.column("_text"))
            h = w.hash.view(np.int64)
            ids, terms = [], []
            for i, name in enumerate(block.column("item").to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b > a:
                    for j in range(a, max(a, b - window) + 1):
                        ids.append(name)
                        terms.append(h[j : min(j + window, b)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    return rows.mapInArrow(run, "item string, terms array<bigint>").groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


def phrase_starts(lists: list[np.ndarray], gaps: int = 0) -> np.ndarray:
    """Starts of places where the terms whose positions are given stand in this order: next to each other, or with up to `gaps` other
    words between two neighbours (then the starts are those from which such a chain exists)."""
    if gaps:
        ahead = lists[-1]
        for one in lists[-2::-1]:
            at = np.searchsorted(ahead, one, side="right")
            ok = at < len(ahead)
            ok[ok] = ahead[at[ok]] - one[ok] <= gaps + 1
            ahead = one[ok]
        return ahead
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    starts = lists[order[0]].astype(np.int64) - order[0]
    starts = starts[starts >= 0]
    for j in order[1:]:
        if not len(starts):
            break
        other = lists[j]
        at = np.searchsorted(other, starts + j)
        ok = at < len(other)
        ok[ok] = other[at[ok]] == starts[ok] + j
        starts = starts[ok]
    return starts


def _search_shard(rows: pa.Table, windows: list[np.ndarray], matrix: np.ndarray, numbers: np.ndarray, gaps: int) -> pa.Table:
    """Hits of windows in one shard: document (its place in the shard), the window's number, first and last word."""
    term, pos = rows.column("term").combine_chunks(), rows.column("positions").combine_chunks()
    docs_row = next(i for i, x in enumerate(term.is_null().to_pylist()) if x)
    firsts = np.frombuffer(rows.column("firsts").combine_chunks()[docs_row].as_py(), np.uint32).astype(np.int64)
    keep = np.array([i for i in range(len(term)) if i != docs_row], np.int64)
    terms = term.take(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64) if len(keep) else np.zeros(0, np.int64)
    order = np.argsort(terms)
    terms, keep = terms[order], keep[order]
    out: list[tuple[int, int, int, int]] = []
    if len(terms):
        at = np.minimum(np.searchsorted(terms, matrix), len(terms) - 1)
        there = (terms[at] == matrix) | (matrix == 0)
        lists: dict[int, np.ndarray] = {}

        def list_of(i: int) -> np.ndarray:
            if i not in lists:
                lists[i] = np.frombuffer(pos[int(keep[i])].as_py(), np.uint32)
            return lists[i]

        for k in np.flatnonzero(there.all(axis=1)).tolist():
            n = len(windows[k])
            got = [list_of(i) for i in at[k, :n].tolist()]
            starts = phrase_starts(got, gaps)
            ends = starts + n - 1
            if gaps and len(starts):
                for one in got[1:]:
                    ends = one[np.minimum(np.searchsorted(one, ends if one is not got[1] else starts, side="right"), len(one) - 1)].astype(np.int64)
            if len(starts):
                doc = np.searchsorted(firsts, starts, side="right") - 1
                ok = ends < firsts[doc + 1]
                out += [(d, int(numbers[k]), s - int(firsts[d]), e - int(firsts[d])) for d, s, e in zip(doc[ok].tolist(), starts[ok].tolist(), ends[ok].tolist(), strict=True)]
    shard = rows.column("shard")[0].as_py()
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table(
        [pa.array([shard] * len(out), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
        names=["shard", "doc_at", "win", "first_word", "last_word"],
    )


def _searcher(sent: Broadcast, gaps: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        lists, matrix, numbers = sent.value
        return _search_shard(shard, lists, matrix, numbers, gaps)

    return run


def search_index(index: DataFrame, windows: DataFrame, gaps: int = 0, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Hits of the windows (from item_windows) in the index: shard, doc_at (the document's place in its shard), items, first_word, last_word.
    The windows go to the executors in passes of about pass_windows, each a pass over the index's rows of those terms; a pass's hits are written
    before the next begins, so that one pass's windows are in memory at a time."""
    spark = index.sparkSession
    parts = max(1, -(-windows.count() // pass_windows))
    numbered = windows.select("terms", "items", F.pmod(F.xxhash64("terms"), F.lit(parts)).alias("part"), F.monotonically_increasing_id().alias("win"))
    windows = materialise(numbered, "windows")  # numbered once
    found = None
    for part in range(parts):
        now = windows.where(F.col("part") == part)
        rows = now.select("win", "terms").collect()  # about pass_windows
        if not rows:
            continue
        lists = [np.array(r["terms"], np.int64) for r in rows]
        matrix = np.zeros((len(lists), max(map(len, lists))), np.int64)
        for k, x in enumerate(lists):
            matrix[k, : len(x)] = x
        sent = spark.sparkContext.broadcast((lists, matrix, np.array([r["win"] for r in rows], np.int64)))
        terms = F.broadcast(now.select(F.explode("terms").alias("term")).distinct())
        needed = index.where("term is not null").join(terms, "term", "left_semi").select(*index.columns).unionByName(index.where("term is null"))
        hits = needed.groupBy("shard").applyInArrow(_searcher(sent, gaps), "shard bigint, doc_at bigint, win bigint, first_word bigint, last_word bigint")
        one = materialise(hits, "hits")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "shard bigint, doc_at bigint, win bigint, first_word bigint, last_word bigint")
    return found.join(windows.select("win", "items"), "win").drop("win")


def index_documents(index: DataFrame) -> DataFrame:
    """The documents of an index: shard, doc_at, id, n_words."""
    rows = index.where("term is null").select("shard", "docs", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for shard, docs, firsts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(docs, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids))), pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(np.frombuffer(firsts, np.uint32).astype(np.int64)))],
                    ["shard", "doc_at", "id", "n_words"],
                )

    return rows.mapInArrow(run, "shard bigint, doc_at bigint, id bigint, n_words bigint")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """One row for each of docs: id, n_words, n_hit (words inside an occurrence of a window), n_items (items with occurring windows),
    items (their ids as sorted strings), spans (merged first and last words of hits), contaminated (n_items >= min_items)."""
    index = build_index(docs, id_col, text_col)
    hits = search_index(index, item_windows(items, window=window))
    per_doc = hits.groupBy("shard", "doc_at").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_set(F.struct("first_word", "last_word"))).alias("spans"),
    )
    # Spans in order of first words: each adds the words behind the largest last word so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["last_word"] - F.greatest(s["first_word"] - 1, a["end"]))).alias("n"),
            F.greatest(a["end"], s["last_word"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    per_doc = per_doc.withColumn("n_hit", covered)
    found = index_documents(index).join(per_doc, ["shard", "doc_at"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first_word:bigint,last_word:bigint>>")).alias("spans"),
        (F.size(items_of) >= min_items).alias("contaminated"),
    )


__all__ = ["build_index", "contamination", "index_documents", "item_windows", "phrase_starts", "search_index"]
