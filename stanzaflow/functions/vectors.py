"""Column functions on numeric arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column, order: float = 2) -> Column:
    """Vector norm of the given order (0, 1, 2, any positive p, inf or -inf)."""
    if order == 2:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    if order == 1:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    if order == 0:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x != 0, 1.0).otherwise(0.0))
    if order == float("inf"):
        return F.array_max(F.transform(v, lambda x: F.abs(x)))
    if order == float("-inf"):
        return F.array_min(F.transform(v, lambda x: F.abs(x)))
    return F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(order)))), F.lit(1.0 / order))


def column_norm(x: Column, order: float = 2) -> Column:
    """Aggregate: the norm of a column of numbers (order 0, any positive p, inf or -inf)."""
    if order == 2:
        return F.sqrt(F.sum(x * x))
    if order == 0:
        return F.sum(F.when(x != 0, 1.0).otherwise(0.0))
    if order == float("inf"):
        return F.max(F.abs(x))
    if order == float("-inf"):
        return F.min(F.abs(x))
    if not order > 0:
        raise ValueError(f"no norm of order {order}")
    return F.pow(F.sum(F.pow(F.abs(x), F.lit(float(order)))), F.lit(1.0 / order))


def unit(v: Column, order: float = 2, eps: float = EPS) -> Column:
    """The vector over its norm, the norm being ``eps`` at least (so zero stays zero)."""
    n = F.greatest(norm(v, order), F.lit(eps))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(n, F.size(v)).alias("n")), lambda s: s["x"] / s["n"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)
