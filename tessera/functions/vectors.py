"""Vector kernels as columns: cosine, bit match, binary signatures, 8-bit quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(_d(a), 1, n), F.slice(_d(b), 1, n), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(_d(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(by))


def soft_threshold(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.greatest(F.abs(x) - F.lit(by), F.lit(0.0)))


def matrix_times(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def bit_match(a: Column, b: Column) -> Column:
    """How many bits of two arrays of bigint are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.lit(64) - F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def signature(v: Column, dim: int, most: int = 2048) -> Column:
    """Bit i is set if v[i] > 0, for the first `most` dimensions; 64 to a bigint."""
    n = min(dim, most)
    words = []
    for w in range(0, n, 64):
        part = F.slice(v, w + 1, min(64, n - w))
        bits = F.transform(part, lambda x, i: F.when(x > 0, _power(i)).otherwise(F.lit(0).cast("bigint")))
        words.append(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)))
    return F.array(*words)


def _power(i: Column) -> Column:
    """2^i as a bigint; 2^63 is its sign bit. Powers of two are looked up in an array of constants."""
    powers = F.array(*(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)))
    return F.element_at(powers, i + 1)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def ranges(vectors: DataFrame, vec_col: str = "vector") -> tuple[list[float], list[float]]:
    """Each dimension's smallest value and range; one number a dimension reaches the driver."""
    rows = vectors.select(F.posexplode(vec_col).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    return [float(r["lo"]) for r in rows], [float(r["hi"]) - float(r["lo"]) for r in rows]


def int8(v: Column, low: list[float], span: list[float]) -> Column:
    """Min-max codes of -127 to 127; a range below 1e-12 counts as 1."""
    lo, sp = F.array(*map(F.lit, low)), F.array(*(F.lit(s if s >= 1e-12 else 1.0) for s in span))
    unit = F.zip_with(F.zip_with(_d(v), lo, lambda x, y: x - y), sp, lambda x, y: x / y)
    return F.transform(unit, lambda x: F.greatest(F.least(F.round(x * 254 - 127), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
