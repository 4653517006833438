"""Array<float|double> vector expressions evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def sq_euclid(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2))


def euclid(a, b) -> Column:
    """Euclidean norm of a - b."""
    return F.sqrt(sq_euclid(a, b))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, of_zeros: float = 0.0) -> Column:
    """Cosine of a and b; ``of_zeros`` where one of them is all zeros, which has no direction."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(of_zeros)).otherwise(dot(a, b) / size)


def to_double_array(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def vsum(a) -> Column:
    return _sum(F.transform(_c(a), lambda x: x.cast("double")))
