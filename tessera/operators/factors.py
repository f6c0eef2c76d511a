"""Non-negative factorisation of all vectors of a table: rows of W stay with their vectors, H is k x d and goes to all tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from ..session import ship


def start(ids: np.ndarray, k: int, d: int, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Start values around the root of the mean over k: W by ids, so that they don't depend on the tasks, and H."""
    level = max(math.sqrt(mean / k), 0.01)

    def spread(seeds: np.ndarray) -> np.ndarray:
        x = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return level * (0.75 + 0.5 * (x >> np.uint64(11)).astype(float) / 2.0**53)

    w = spread((np.asarray(ids, np.int64)[:, None] * k + np.arange(k)).view(np.uint64) + np.uint64(1))
    return w, spread((np.arange(k * d, dtype=np.uint64) + np.uint64(1 << 62))).reshape(k, d)


def nmf_rows(vectors: DataFrame, k: int, iterations: int = 10, vec_col: str = "vector") -> np.ndarray:
    """H of |V| = W H over all vectors (id, vector) of one dimension, by multiplicative updates. Each round is a pass over the rows that sends k x d and
    k x k sums of each task to the driver, whatever the number of rows; W is written with the rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.size(vec_col) > 0).select(F.col("id").cast("bigint").alias("id"), F.transform(vec_col, lambda x: F.abs(x.cast("double"))).alias("v"))
    shape = rows.agg(F.max(F.size("v")).alias("d"), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean")).first()
    d, mean = shape["d"] or 0, shape["mean"] or 0.0
    if not d:
        return np.zeros((k, 0))
    h = start(np.zeros(0, np.int64), k, d, mean)[1]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column("id").to_numpy()
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
        w = batch.column("w")
        return ids, v, start(ids, k, d, mean)[0] if w.null_count else w.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), k)

    def updated(h: np.ndarray | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, v, w = read(batch)
                    if h is not None:
                        w = w * ((v @ h.T) / np.maximum(w @ (h @ h.T), 1e-10))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * k, pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "w"])

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wv, ww = np.zeros((k, d)), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                _, v, w = read(batch)
                wv += w.T @ v
                ww += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * d + k * k)), pa.array(np.concatenate([wv.ravel(), ww.ravel()]))], ["at", "x"])

    rows = rows.where(F.size("v") == d).withColumn("w", F.lit(None).cast("array<double>"))
    for n in range(iterations):
        rows = cut(rows.mapInArrow(updated(h if n else None), "id bigint, v array<double>, w array<double>"))
        total = np.zeros(k * d + k * k)
        for r in rows.mapInArrow(sums, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # k d + k k rows
            total[r["at"]] = r["x"]
        wv, ww = total[: k * d].reshape(k, d), total[k * d :].reshape(k, k)
        h = h * wv / np.maximum(ww @ h, 1e-10)
    return h
