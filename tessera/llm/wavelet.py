"""Token files: one wavelet matrix for each shard of token ids.

A wavelet matrix holds a sequence as bit-planes from the highest bit of a symbol to the lowest. Plane l has bit l of every symbol, in
the order that results if the sequence was split stably by each higher bit, zeros first. With the number of set bits before each block
of a plane (rank), one symbol, the count of a symbol before a place, and the place of its k-th occurrence each take one step a plane.

File: magic, then little-endian int64 n (ids), n_docs, levels; document ids (int64); starts of documents in ids, and the end (int64); for
each plane its zeros (int64); for each plane the set bits before each block of 512 (uint32) and the bits (bytes, highest bit first).
The file is kept as one binary value of a Parquet row, so that Spark's writers commit it once even if a task runs twice.

Defined results: null texts count as empty and have only the end id; repeated rows are written each; other columns are not read; an
empty table gives no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, materialise, settle, tune
from .positional_index import NO_ID
from .tokens import encoder, tokenizer_path, with_end

MAGIC = b"TWM1"
BLOCK = 512
#: Ids in a file, about; a longer document is not cut.
FILE_IDS = 1 << 20


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (a & a.dtype.type(1 << level)) != 0
            plane = np.packbits(bit)
            planes.append(plane)
            padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            low = a[~bit]
            zeros.append(len(low))
            a = np.concatenate([low, a[bit]])
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, plane: int, i: int) -> int:
        """Set bits among the first i of a plane."""
        block = i // BLOCK
        part = self.planes[plane][block * (BLOCK // 8) : i // 8]
        total = int(self.ranks[plane][block]) + int(np.bitwise_count(part).sum())
        if i % 8:
            total += int(self.planes[plane][i // 8] >> (8 - i % 8)).bit_count()
        return total

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        out = 0
        for p in range(self.levels):
            bit = self._bit(p, i)
            out = out << 1 | bit
            i = self.zeros[p] + self._ones(p, i) if bit else i - self._ones(p, i)
        return out

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for p in range(self.levels):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if symbol >> (self.levels - 1 - p) & 1:
                lo, hi = self.zeros[p] + a, self.zeros[p] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol stands among the first i ids."""
        lo, hi = self._span(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The place of symbol's occurrence number k, from 0."""
        if symbol >> self.levels or not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._span(symbol, self.n)[0] + k
        for p in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _select_bit(self, p: int, bit: int, k: int) -> int:
        lo, hi = 0, self.n
        while lo < hi:  # the first place with more than k such bits up to it
            mid = (lo + hi) // 2
            ones = self._ones(p, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def locate(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane puts the two parts behind it back in order."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for p in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], count=self.n).view(bool)
            out = np.empty_like(a)
            out[~bit] = a[: self.zeros[p]]
            out[bit] = a[self.zeros[p] :] | a.dtype.type(1 << (self.levels - 1 - p))
            a = out
        return a


def to_file(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, levels: int) -> bytes:
    m = WaveletMatrix.build(ids, levels)
    parts = [MAGIC, np.array([len(ids), len(doc_ids), levels], "<i8"), doc_ids.astype("<i8"), starts.astype("<i8"), np.array(m.zeros, "<i8")]
    for rank, plane in zip(m.ranks, m.planes, strict=True):
        parts += [rank.astype("<u4"), plane]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def from_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids, and their starts with the end. Nothing is copied."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    n, n_docs, levels = map(int, take("<i8", 3))
    doc_ids, starts, zeros = take("<i8", n_docs), take("<i8", n_docs + 1), take("<i8", levels)
    size = -(-n // 8)
    blocks_ = -(-size // (BLOCK // 8)) + 1
    ranks, planes = [], []
    for _ in range(levels):
        ranks.append(take("<u4", blocks_))
        planes.append(take("u1", size))
    return WaveletMatrix(n, planes, zeros.tolist(), ranks), doc_ids, starts


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs in ascending id order and reads back part, file_no (together ascending), n_ids, file."""
    tune(docs.sparkSession)
    where = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "_id").sortWithinPartitions("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        part, file_no = TaskContext.get().partitionId(), 0
        levels = max(1, (encoder(where).tokenizer.get_vocab_size() - 1).bit_length())
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def file() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            data = to_file(np.concatenate(ids), np.concatenate(held), starts, levels)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([file_no], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([data], pa.binary())], ["part", "file_no", "n_ids", "file"])

        for block in blocks(batches, "_text"):
            got, first = with_end(*encoder(where).encode(block.column("_text")))
            ids.append(got)
            lens.append(np.diff(first))
            held.append(pc.fill_null(block.column("_id"), NO_ID).to_numpy())
            size += len(got)
            if size >= file_ids:
                yield file()
                file_no += 1
                ids, lens, held, size = [], [], [], 0
        if held:
            yield file()

    return materialise(rows.mapInArrow(run, "part bigint, file_no bigint, n_ids bigint, file binary"), "tokens", "snappy")


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if wanted."""
    sizes = files.select("part", "file_no", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("file_no")
    bases = sizes.withColumn("base", F.sum("n_ids").over(inner) - F.col("n_ids")).join(parts, "part").select("part", "file_no", (F.col("base") + F.col("part_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        for batch in batches:
            for part, file_no, data in zip(batch.column("part").to_pylist(), batch.column("file_no").to_pylist(), batch.column("file"), strict=True):
                m, doc_ids, starts = from_file(data.as_py())
                ids = m.decode().astype("<u4")
                n = len(doc_ids)
                raw = memoryview(ids.tobytes())
                cut = (starts * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                cols = [pa.array(np.full(n, part)), pa.array(np.full(n, file_no)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                names = ["part", "file_no", "_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([raw[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = "part bigint, file_no bigint, _id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # each row is a file
    docs = files.select("part", "file_no", "file").mapInArrow(run, kind)
    return docs.join(bases, ["part", "file_no"]).select(F.col("_id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
