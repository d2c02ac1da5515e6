"""Query features and routing to retrievers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES = {"keyword": ("bm25", "sparse"), "semantic": ("dense",), "hybrid": ("bm25", "dense"), "unknown": ("bm25", "dense")}


@dataclass(frozen=True)
class UtilityMetrics:
    """What a retriever gave for a query, for training a router elsewhere."""

    retriever: str
    ndcg: float = 0.0
    recall: float = 0.0
    latency_ms: float = 0.0


@dataclass(frozen=True)
class RouterTrainingConfig:
    """Settings for a trainer outside this package."""

    metric: str = "ndcg"
    epochs: int = 10
    learning_rate: float = 0.01
    validation_share: float = 0.2


def features(terms: str | Column) -> Column:
    """n_terms, avg_length (bytes), complexity (distinct terms over terms) and kind of a query."""
    t = F.col(terms) if isinstance(terms, str) else terms
    n = F.size(t)
    length = F.aggregate(t, F.lit(0), lambda acc, x: acc + F.octet_length(x)) / n
    share = F.size(F.array_distinct(t)) / n
    kind = F.when(n == 0, "unknown").when((share > 0.8) & (length > 5), "semantic").when((share < 0.5) & (length < 4), "keyword").otherwise("hybrid")
    zero = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c)
    return F.struct(n.alias("n_terms"), zero(length).alias("avg_length"), zero(share).alias("complexity"), kind.alias("kind"))


def route(terms: str | Column, enabled: bool = True, fixed: str = "bm25") -> Column:
    """The retrievers for a query; the fixed one while routing is off."""
    if not enabled:
        return F.array(F.lit(fixed))
    kind = features(terms)["kind"]
    out = F.when(kind == "keyword", F.array(*map(F.lit, ROUTES["keyword"])))
    for name in ("semantic", "hybrid"):
        out = out.when(kind == name, F.array(*map(F.lit, ROUTES[name])))
    return out.otherwise(F.array(*map(F.lit, ROUTES["unknown"])))


def routed(queries: DataFrame, enabled: bool = True) -> DataFrame:
    """(query_id, terms) with n_terms, avg_length, complexity, kind, retrievers."""
    return queries.select("*", features("terms").alias("f"), route("terms", enabled).alias("retrievers")).select("*", "f.*").drop("f")
