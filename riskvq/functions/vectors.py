"""Vector arithmetic on ``array<double>`` columns.

All functions return Spark column expressions (higher-order functions run
inside the JVM).  Arrays of unequal length give NULL rather than a silent
zero.  ``skip_last=1`` reproduces the reference's summation loop, which stops
one element short; the default sums every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _drop_last(v: Column, skip_last: int) -> Column:
    if not skip_last:
        return v
    return F.slice(v, 1, F.greatest(F.size(v) - F.lit(skip_last), F.lit(0)))


def _fold_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _same_size(a: Column, b: Column, expr: Column) -> Column:
    return F.when(F.size(a) == F.size(b), expr)


def vec_sum(v, skip_last: int = 0) -> Column:
    """Sum of the elements (V1)."""
    return _fold_sum(_drop_last(_c(v), skip_last))


def vec_sqdist(a, b) -> Column:
    """Squared Euclidean distance (V2)."""
    a, b = _c(a), _c(b)
    return _same_size(a, b, _fold_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def vec_dist(a, b) -> Column:
    """Euclidean distance (V3)."""
    return F.sqrt(vec_sqdist(a, b))


def vec_add(a, b) -> Column:
    """Element-wise sum (V4)."""
    a, b = _c(a), _c(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vec_sub(a, b) -> Column:
    """Element-wise difference (V5)."""
    a, b = _c(a), _c(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vec_dot(a, b, skip_last: int = 0) -> Column:
    """Dot product (V6)."""
    a, b = _c(a), _c(b)
    return _same_size(a, b, _fold_sum(_drop_last(F.zip_with(a, b, lambda x, y: x * y), skip_last)))


def vec_scale(x, v) -> Column:
    """Scalar (literal or column) times vector (V7)."""
    xs = x if isinstance(x, Column) else F.lit(float(x))
    return F.transform(_c(v), lambda e: xs * e)
