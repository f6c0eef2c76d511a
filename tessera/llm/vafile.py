"""Exact top-k search with vector-approximation files.

Vectors of integers stand in blocks. In a block each dimension's range is cut into equal cells, and a vector's approximation is the
cells' numbers, one byte each. For a query q, the middle of a vector's cells gives a score m, and the true inner product lies within
m - c and m + c, where c = sum |q_i| * half a cell, the same for all of a block. A scan computes bounds from the approximations alone;
then exact vectors are read in order of their best possible score until no bound reaches the k-th result. What a task found in earlier
blocks bounds later ones. Each task gives k rows a query at most, so that equal or hot vectors can't swell what is merged.

Queries are taken in passes of bounded size, each against all rows; a pass is written before the next begins, so that one pass's queries are
in memory at a time. Defined results: vectors that are null, empty, or hold null or
non-finite components take no part; a query meets the vectors of its own dimension; rows with a query's id are its own and left out, and
of repeated query rows one asks; ties go to the smaller id; fewer than k candidates give fewer rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, materialise, scratch, settle, tune

BLOCK_VECTORS = 2048
#: Cells a dimension is cut into.
CELLS = 256
#: Queries in one pass over the file.
PASS_QUERIES = 8192
#: Rows of the file in one Arrow batch: each is a block.
FILE_ROWS = 8
#: Exact vectors read at once for a query.
STEP = 32


def scaled(vector: Column, factor: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def build_file(vectors: DataFrame, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Blocks: dim, ids (int64), low and step (int64, each dimension's first cell and cell width), codes (uint8), exact (int64)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            col, ids = batch.column("v"), batch.column("id").to_numpy(zero_copy_only=False)
            at = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                index = at[which][:, None] + np.arange(dim)
                held.setdefault(dim, []).append((ids[which], flat[index]))
                if sum(len(x) for x, _ in held[dim]) >= BLOCK_VECTORS:
                    yield from _blocks(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from _blocks(dim, parts)

    return rows.mapInArrow(run, "dim int, ids binary, low binary, step binary, codes binary, exact binary")


def _blocks(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    ids, v = np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts]).astype(np.int64)
    for lo in range(0, len(ids), BLOCK_VECTORS):
        i, x = ids[lo : lo + BLOCK_VECTORS], v[lo : lo + BLOCK_VECTORS]
        low = x.min(axis=0)
        step = (x.max(axis=0) - low) // CELLS + 1
        codes = ((x - low) // step).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in (i, low, step, codes, x))], ["dim", "ids", "low", "step", "codes", "exact"])


class TopK:
    """The k best (score, id) of each of some queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.kth = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]
        if len(order) == self.k:
            self.kth[q] = self.score[q][-1]


def _scan(top: TopK, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray, exact: np.ndarray) -> int:
    """Adds a block's vectors to top. Returns how many exact vectors were read."""
    k, read = top.k, 0
    cells, half = codes.astype(np.float32), (step - 1) / 2
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256].astype(float)
        m = (q * step).astype(np.float32) @ cells.T + (q @ (low + half))[:, None]
        # half a cell on either side, and room for rounding: of single precision in the sum over cells, of double in the rest
        c = np.abs(q) @ (half + (len(step) + 4) * 2.0**-23 * CELLS * step + 1e-9 * (np.abs(low) + CELLS * step)) + 1
        m[query_ids[a : a + 256, None] == ids] = -np.inf
        kth = top.kth[a : a + 256].copy()
        if m.shape[1] >= k:
            kth = np.maximum(kth, np.partition(m, m.shape[1] - k, axis=1)[:, -k] - c)
        for j in range(len(q)):
            upper = m[j] + c[j]
            near = np.flatnonzero((upper >= kth[j]) & np.isfinite(upper))
            near = near[np.argsort(-upper[near], kind="stable")]
            for b in range(0, len(near), STEP):
                part = near[b : b + STEP]
                part = part[upper[part] >= top.kth[a + j]]
                if not len(part):
                    break
                read += len(part)
                top.add(a + j, exact[part] @ queries[a + j], ids[part])
    return read


def search_file(file: DataFrame, queries: DataFrame, k: int = 10, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest inner products of each query (id, v) with the file's vectors."""
    spark = file.sparkSession
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked = materialise(asked, "queries")
    passes = max(1, -(-asked.count() // pass_queries))
    found = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).collect()  # about pass_queries
        if not rows:
            continue
        by_dim: dict[int, tuple[list[int], list[list[int]]]] = {}
        for r in sorted(rows, key=lambda r: r["id"]):
            ids, vs = by_dim.setdefault(len(r["v"]), ([], []))
            ids.append(r["id"])
            vs.append(r["v"])
        sent = spark.sparkContext.broadcast({dim: (np.array(a, np.int64), np.array(b, np.int64)) for dim, (a, b) in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            settle()
            tops = {dim: TopK(len(ids), k) for dim, (ids, _) in sent.value.items()}
            for batch in batches:
                for dim, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if dim not in tops:
                        continue
                    ids, low, step = (np.frombuffer(x, np.int64) for x in parts[:3])
                    codes = np.frombuffer(parts[3], np.uint8).reshape(-1, dim)
                    exact = np.frombuffer(parts[4], np.int64).reshape(-1, dim)
                    _scan(tops[dim], *sent.value[dim], ids, low, step, codes, exact)
            for dim, top in tops.items():
                n = [len(x) for x in top.id]
                cols = [np.repeat(sent.value[dim][0], n), np.concatenate(top.id), np.concatenate(top.score)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "id", "score"])

        one = file.select("dim", "ids", "low", "step", "codes", "exact").mapInArrow(run, "query_id bigint, id bigint, score bigint")
        with batch_rows(spark, FILE_ROWS):
            one = materialise(one, "best", keep=True)
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 1024, k: int = 10) -> DataFrame:
    """query_id, rank, id, score over vectors scaled to floor(factor * x); the rows where is_query holds ask."""
    tune(vectors.sparkSession)
    good = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col), factor).alias("v"), is_query.alias("asks"))
    with scratch(vectors.sparkSession):
        file = materialise(build_file(good), "vafile")
        return search_file(file, good.where("asks").select("id", "v"), k)
