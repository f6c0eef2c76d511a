"""Packing token sequences: shortest-pack-first over the length histogram.

A document's ids are cut into pieces of the sequence length and a rest. The histogram of piece lengths has as many entries as a sequence
has tokens, so packing happens on it: lengths are placed from the longest down, each into the shortest packs that still have room, by
moving counts between packing patterns; what finds no room opens packs. Patterns are then joined back to pieces by the rank of a piece
among those of its length. A pattern's packs are numbered in one run, so a slot of a pattern takes a run of ranks.

Defined results: a null or empty text has its end id only; repeated rows are packed each; other columns are not read; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, materialise, settle, tune
from .tokens import encoder, tokenizer_path, with_end

LENGTH = 1024


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one pack) and how many packs have each. At most two new patterns arise for each length and pattern used up."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if not 0 < size <= length:
            raise ValueError(f"length {size}")
        made: list[tuple[int, tuple[tuple[int, ...], int]]] = []
        while left:
            free = max(room, default=0)  # of the shortest packs
            if free < size:
                made.append((length - size, ((size,), left)))
                break
            pattern, count = room[free].pop()
            if not room[free]:
                del room[free]
            take = min(left, count)
            made.append((free - size, ((*pattern, size), take)))
            if count > take:
                room.setdefault(free, []).append((pattern, count - take))
            left -= take
            if free - size >= size:  # as short as others: further pieces of this length may go on top
                room.setdefault(free - size, []).append(made.pop()[1])
        for free, pack in made:
            room.setdefault(free, []).append(pack)
    return [pack for free in sorted(room) for pack in room[free]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, end of ranks, sequence of the first rank, offset: for each place in a pattern."""
    out, ranks, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            lo = ranks.get(size, 0)
            ranks[size] = lo + count
            out.append((size, lo, lo + count, sequence, offset))
            offset += size
        sequence += count
    return out


def padding(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> int:
    """Padded tokens; a sequence whose length is a power of two is not padded."""
    return sum(count * (length - n) for pattern, count in patterns if (n := sum(pattern)) & (n - 1))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of docs: id, start, length, ids_crc32, doc_tokens, task and rank (a piece's number among those of its length in its task)."""
    tune(docs.sparkSession)
    where = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for block in blocks(batches, "_text"):
            ids, first = with_end(*encoder(where).encode(block.column("_text")))
            raw = memoryview(ids.astype("<u4").tobytes())
            n = np.diff(first)
            pieces = -(-n // length)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, n[doc] - start)
            # the rank: so many of this length before it in the block, and in earlier blocks
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(size, minlength=length + 1)
            lo = ((first[doc] + start) * 4).tolist()
            hi = ((first[doc] + start + size) * 4).tolist()
            cols = [block.column("_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(lo, hi, strict=True)], pa.int64()), pa.array(n[doc]), pa.array(np.full(len(doc), task, np.int64)), pa.array(rank)]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
            if with_ids:
                cols.append(pa.array([raw[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, rank bigint" + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, uint32, if wanted)."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, id_col, text_col, path, length, with_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("task")
    bases = by_task.withColumn("base", F.sum("n").over(w) - F.col("n")).select("length", "task", "base")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    runs = slots(shortest_pack_first(histogram, length))
    table = spark.createDataFrame(runs, "length bigint, lo bigint, hi bigint, sequence bigint, offset bigint")
    # Patterns number at most a few for each length, whatever the corpus: they are small enough to broadcast.
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    put = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["rank"] >= table["lo"]) & (ranked["rank"] < table["hi"])).drop(table["length"])
    return put.select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids
    )


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (uint32, padded to length unless their number is a power of two), n_ids: from pack(..., with_ids=True)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.unhex(F.concat_ws("", parts)).alias("ids"))
    n = F.col("n_ids")
    power = n.bitwiseAND(n - 1) == 0
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.lit(length) - n.cast("int")))
    return rows.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", pad)).alias("ids"), "n_ids")
