"""Rank fusion of result lists (query_id, doc_id, score, rank) given by method name.

Ranks count from 1. One shuffle by query and document; methods that scale scores need a list's bounds, which are a
few rows a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators.topk import ranked

RRF_K = 60


def stacked(lists: dict[str, DataFrame]) -> DataFrame:
    """(method, query_id, doc_id, score, rank) of all lists."""
    parts = [df.select(F.lit(name).alias("method"), "query_id", "doc_id", "score", "rank") for name, df in lists.items()]
    if not parts:
        raise InvalidParameter("no lists to fuse")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sum(rows: DataFrame, value, k: int | None) -> DataFrame:
    return ranked(rows.groupBy("query_id", "doc_id").agg(value.alias("score")), k)


def rrf(lists: dict[str, DataFrame], k: int | None = 10, constant: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank)."""
    return _sum(stacked(lists), F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), k)


def isr(lists: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    """Inverse square rank: number of lists times the sum of 1 / rank**2."""
    return _sum(stacked(lists), F.count("*") * F.sum(1 / (F.col("rank") * F.col("rank"))), k)


def borda(lists: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    """Sum of the number of results of the list less the rank."""
    rows = stacked(lists)
    sizes = rows.groupBy("method", "query_id").agg(F.count("*").alias("n"))
    return _sum(rows.join(sizes, ["method", "query_id"]), F.sum((F.col("n") - F.col("rank")).cast("double")), k)


def _scaled(lists: dict[str, DataFrame]) -> DataFrame:
    """Scores of each list and query brought to 0..1; 1 where they are all equal."""
    rows = stacked(lists)
    ends = rows.groupBy("method", "query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return rows.join(ends, ["method", "query_id"]).withColumn("scaled", scaled)


def combsum(lists: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    return _sum(_scaled(lists), F.sum("scaled"), k)


def combmnz(lists: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    return _sum(_scaled(lists), F.sum("scaled") * F.count("*"), k)


def weighted(lists: dict[str, DataFrame], weights: dict[str, float], k: int | None = 10) -> DataFrame:
    """Sum of the list's weight times the scaled score."""
    w = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(v))) for m, v in weights.items()], F.lit(0.0))
    return _sum(_scaled(lists), F.sum(w * F.col("scaled")), k)


def dbsf(lists: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    """Distribution-based: scores cut to and scaled by three standard deviations about the mean, then summed."""
    rows = stacked(lists)
    stats = rows.groupBy("method", "query_id").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("score") - (F.col("mu") - 3 * F.col("sd"))) / (6 * F.col("sd"))).otherwise(0.5)
    return _sum(rows.join(stats, ["method", "query_id"]), F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))), k)
