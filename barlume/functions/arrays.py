"""Vectors in array columns: expressions over them, and sums over all rows that need no more memory than their dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.plans.staging import matrix, summed


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def literal(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    """The vector at length 1; zeros stay."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(F.col(v))


def dimension(df: DataFrame, vector: str) -> int:
    """The one length of the vectors, which hold no nulls; ValueError otherwise, or without rows."""
    s = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count_if(F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))).alias("bad"), F.count("*").alias("n")).first()
    if not s["n"] or s["bad"] or s["lo"] != s["hi"] or s["lo"] < 1:
        raise ValueError("vectors must be there, complete and of one length")
    return s["lo"]


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, spread): population spread of every component, 1 where there is none. The second pass takes differences from the mean."""
    d = dimension(df, vector)
    first = summed(df.select(vector), lambda b: np.concatenate([[b.num_rows], matrix(b.column(0)).sum(axis=0)]), (d + 1,))
    n, mean = int(first[0]), first[1:] / first[0]
    spread = np.sqrt(summed(df.select(vector), lambda b: ((matrix(b.column(0)) - mean) ** 2).sum(axis=0), (d,)) / n)
    return n, mean, np.where(spread > 1e-12 * (1 + np.abs(mean)), spread, 1.0)


def standardised(v: str, mean: np.ndarray, spread: np.ndarray) -> Column:
    return F.zip_with(F.zip_with(v, literal(mean), lambda x, m: x - m), literal(spread), lambda x, s: x / s)


def principal_axes(df: DataFrame, vector: str) -> np.ndarray:
    """Rows: the axes of the vectors about 0, the longest first, each with its largest component above 0."""
    d = dimension(df, vector)
    gram = summed(df.select(vector), lambda b: (x := matrix(b.column(0))).T @ x, (d, d))
    axes = np.linalg.eigh((gram + gram.T) / 2)[1].T[::-1]
    return axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(axis=1)])[:, None]


def at_length_one(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)
