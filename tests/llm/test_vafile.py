import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import vafile


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in dict((i, v) for i, v in good if i % 100 == 0).items():
        scores = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), i) for i, u in good if i != q and len(u) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string")


def test_top_k_against_brute_force(spark):
    rng = random.Random(6)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(16)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # ties
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, []), (None, rows[1][1]), (2100, [0.5, 0.25]), (2200, [1.0, 2.0]), (2300, [0.0] * 16)]
    df = frame(spark, rows)
    got = vafile.exact_top_k(df, F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert vafile.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert vafile.exact_top_k(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


def test_queries_in_passes(spark):
    rng = random.Random(7)
    rows = [(i, [round(rng.random(), 3) for _ in range(4)]) for i in range(400)]
    v = frame(spark, rows).select(F.col("vec_id").alias("id"), vafile.scaled(F.col("embedding")).alias("v"))
    file = vafile.build_file(v)
    one = vafile.search_file(file, v.where("id % 20 = 0"), 5)
    many = vafile.search_file(file, v.where("id % 20 = 0"), 5, pass_queries=3)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()} and one.count() == 100


def test_bounds_leave_most_exact_vectors_unread():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.normal(0, 0.3, (vafile.BLOCK_VECTORS, 32))).astype(np.int64)
    b = next(vafile._blocks(32, [(np.arange(len(x)), x)]))
    ids, low, step = (np.frombuffer(b.column(c)[0].as_py(), np.int64) for c in ("ids", "low", "step"))
    codes = np.frombuffer(b.column("codes")[0].as_py(), np.uint8).reshape(-1, 32)
    assert (low + codes * step <= x).all() and (x < low + (codes.astype(int) + 1) * step).all()
    top = vafile.TopK(20, 10)
    read = vafile._scan(top, np.arange(20), x[:20], ids, low, step, codes, x)
    assert read < 0.1 * 20 * len(x)
    s = x[:20] @ x.T
    s[np.arange(20), np.arange(20)] = -(1 << 60)
    assert all(set(top.score[q].tolist()) == set(np.sort(s[q])[-10:].tolist()) for q in range(20))
