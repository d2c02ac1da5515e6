"""Metadata predicates, facets, selectivity, and filters fused into vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter


def equals(field: str, value) -> Column:
    """False, not null, where the field is missing."""
    return F.coalesce(F.col(field) == F.lit(value), F.lit(False))


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def selectivity(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row: the share of rows that match, null for an empty table."""
    return rows.agg(F.avg(predicate.cast("double")).alias("selectivity"))


def values_of(rows: DataFrame, field: str) -> DataFrame:
    return rows.select(F.col(field).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")


def facet_counts(rows: DataFrame, field: str, predicate: Column | None = None) -> DataFrame:
    """value, n by falling n, of ties the smaller value first; of rows that match ``predicate`` if given."""
    rows = rows if predicate is None else rows.filter(predicate)
    return rows.select(F.col(field).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def augment(embedding: str | Column, category: Column, categories: int, weight: float) -> Column:
    """The vector with ``weight`` times the one-hot code of the category behind it."""
    if categories < 1:
        raise InvalidParameter("at least one category")
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    hot = F.transform(F.sequence(F.lit(0), F.lit(categories - 1)), lambda i: F.when(i == category, F.lit(float(weight))).otherwise(F.lit(0.0)))
    fits = F.assert_true((category >= 0) & (category < categories), "a category is out of range")
    return F.when(fits.isNull(), F.concat(F.transform(e, lambda v: v.cast("double")), hot))


def original(augmented: str | Column, dim: int) -> Column:
    return F.slice(augmented, 1, dim)
