"""Vectors as arrays: all arithmetic in double precision, on the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zeros."""
    m = magnitude(a)
    return F.when(m == 0, F.transform(doubles(a), lambda x: F.lit(0.0))).otherwise(F.transform(doubles(a), lambda x: x / m))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(a: Column, by: float) -> Column:
    return F.transform(doubles(a), lambda x: x * by)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; raises where lengths differ; 0 for a zero vector.  Norms may be given."""
    n = (magnitude(a) if norm_a is None else norm_a) * (magnitude(b) if norm_b is None else norm_b)
    differ = F.size(a) != F.size(b)
    return F.when(differ, F.raise_error(F.lit("vectors differ in length")).cast("double")).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def similarity(a: Column, b: Column) -> Column:
    """Cosine within 0..1; 0 where a vector is missing, zero or of another length."""
    n = magnitude(a) * magnitude(b)
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(fit & (n > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / n))).otherwise(0.0)


@F.pandas_udf(T.BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(b: pd.Series) -> pd.Series:
    """Floats of a blob; null unless its size is a multiple of four bytes."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4").tolist())


def _unit(v: np.ndarray) -> list[float]:
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def running_hash(codes: list[int], times: int, start: int) -> list[int]:
    """h -> times * h + code in wrapped signed 32-bit arithmetic, after each code."""
    out, h = [], start
    for c in codes:
        h = (h * times + c + 2**31) % 2**32 - 2**31
        out.append(h)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def placeholder_embedding(text: pd.Series) -> pd.Series:
    """384 numbers from a running hash: its last three decimal digits, by position; unit length."""

    def one(t: str | None) -> list[float]:
        v = np.zeros(384)
        for i, h in enumerate(running_hash([ord(c) for c in t or ""], 31, 0)):
            v[i % 384] = np.fmod(h, 1000) / 1000
        return _unit(v)

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """384 numbers from one hash for every 32 characters, whose bits are spread from that place on; unit length."""
    shifts = np.arange(384) % 32

    def one(t: str | None) -> list[float]:
        v, t = np.zeros(384), t or ""
        for at in range(0, len(t), 32):
            h = abs(running_hash([ord(c) for c in t[at : at + 32]], 33, 5381)[-1])
            v += np.roll((h >> shifts & 255) / 255.0 * 0.3, at % 384)
        return _unit(v)

    return text.map(one)
