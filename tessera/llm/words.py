"""Word arrays: each text as the low 32 bits of its words' hashes, written once where several steps read them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, settle, tune
from .wordscan import Words


def binary_slices(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: the items of data from first[i] to first[i + 1]."""
    offsets = (first * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def word_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words (binary, uint32 little-endian)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for block in blocks(batches, "_text"):
            w = Words(block.column("_text"))
            yield pa.RecordBatch.from_arrays([block.column("id"), binary_slices(w.hash.astype(np.uint32), w.first)], ["id", "words"])

    return rows.mapInArrow(run, "id bigint, words binary")


def read_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of word arrays without nulls, and where each text's begin (one more at the end)."""
    off = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data.view(np.uint32) if off[0] % 4 == 0 else data.copy().view(np.uint32), (off - off[0]) // 4
