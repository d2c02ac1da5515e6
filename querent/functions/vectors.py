"""Vector expressions on array columns, in double precision; of unequal lengths the common prefix counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
TINY = 1e-9


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    product = lambda x, y: x.cast("double") * y.cast("double")
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), product))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda v: v.cast("double") * v.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either norm is tiny."""
    x, y = norm(a), norm(b)
    return F.when((x <= TINY) | (y <= TINY), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - dot, for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Infinite for unequal lengths."""
    a, b = _col(a), _col(b)
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(_sum(gap))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product_distance(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)
