"""Distances as Column expressions, and the same sums in numpy.

All sums run in double, in index order, so that the SQL and the numpy forms agree to the bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import IntEnum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import EngineIOError, InvalidParameter

#: Below this product of squared norms the cosine distance is 1.
TINY = 1e-12


class Metric(IntEnum):
    """Squared Euclidean, cosine and negative dot product; the values are the files' codes."""

    L2 = 0
    COSINE = 1
    DOT = 2

    @classmethod
    def parse(cls, name: str) -> Metric:
        names = {"l2": cls.L2, "L2": cls.L2, "cosine": cls.COSINE, "Cosine": cls.COSINE, "dot": cls.DOT, "Dot": cls.DOT}
        if name not in names:
            raise InvalidParameter(f"unknown metric {name!r}")
        return names[name]

    @classmethod
    def from_code(cls, code: int, strict: bool = True) -> Metric:
        """Strict: a file's code, else an I/O error. Lenient: anything unknown is L2."""
        if code in (0, 1, 2):
            return cls(code)
        if strict:
            raise EngineIOError("invalid metric in file")
        return cls.L2


def vector_literal(values: Sequence[float]) -> Column:
    """A query in single precision, as stored vectors are."""
    return F.array(*[F.lit(float(np.float32(v))) for v in values])


def _col(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner_product(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def l2(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def dot(a, b) -> Column:
    return -inner_product(a, b) + F.lit(0.0)


def cosine(a, b) -> Column:
    return cosine_of(inner_product(a, b), inner_product(a, a) * inner_product(b, b))


def cosine_of(product: Column, norms: Column) -> Column:
    """The cosine distance, of the inner product and the product of the squared norms."""
    share = product / F.sqrt(norms)
    return F.when(norms < TINY, F.lit(1.0)).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))


def distance(metric: Metric, a, b) -> Column:
    return {Metric.L2: l2, Metric.COSINE: cosine, Metric.DOT: dot}[metric](a, b)


def fold(products: np.ndarray) -> np.ndarray:
    """Sums along the last axis, one term after the other."""
    total = np.zeros(products.shape[:-1])
    for i in range(products.shape[-1]):
        total = total + products[..., i]
    return total


def distances(metric: Metric, query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact distances of one query to the rows of `vectors`, or of paired rows."""
    q, v = np.asarray(query, float), np.asarray(vectors, float)
    if metric is Metric.L2:
        return fold((q - v) * (q - v))
    product = fold(q * v)
    if metric is Metric.DOT:
        return -product + 0.0
    norms = fold(q * q) * fold(v * v)
    safe = np.where(norms < TINY, 1.0, norms)
    return np.where(norms < TINY, 1.0, 1.0 - np.clip(product / np.sqrt(safe), -1.0, 1.0))
