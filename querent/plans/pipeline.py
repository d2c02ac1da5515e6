"""A retrieval pipeline as a plan: retrievers, fusion, reranking, evaluation; one lazy DataFrame in the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from querent.errors import InvalidParameter
from querent.operators import evaluation, fusion, rerank

FUSIONS = {"rrf": fusion.rrf, "isr": fusion.isr, "borda": fusion.borda, "combsum": fusion.combsum, "combmnz": fusion.combmnz, "dbsf": fusion.dbsf}


@dataclass(frozen=True)
class Plan:
    """Steps are added by methods that return a new plan; nothing runs before the result is used."""

    retrievers: tuple[tuple[str, Callable[[int], DataFrame], int], ...] = ()
    fuse_by: str = "rrf"
    fuse_k: int = 100
    weights: dict[str, float] | None = None
    rerankers: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    final_k: int | None = None
    notes: dict = field(default_factory=dict)

    def retrieve(self, name: str, how: Callable[[int], DataFrame], k: int = 1000) -> Plan:
        """``how(k)`` gives query_id, doc_id, score, rank."""
        return replace(self, retrievers=(*self.retrievers, (name, how, k)))

    def fuse(self, by: str = "rrf", k: int = 100, weights: dict[str, float] | None = None) -> Plan:
        if by not in FUSIONS and by != "weighted":
            raise InvalidParameter(f"unknown fusion {by}")
        return replace(self, fuse_by=by, fuse_k=k, weights=weights)

    def rerank(self, vectors: DataFrame, queries: DataFrame, k: int = 10) -> Plan:
        return replace(self, rerankers=(*self.rerankers, lambda rows: rerank.rerank_cosine(rows, vectors, queries, k)))

    def top(self, k: int) -> Plan:
        return replace(self, final_k=k)

    def lists(self) -> dict[str, DataFrame]:
        if not self.retrievers:
            raise InvalidParameter("a plan needs a retriever")
        return {name: how(k) for name, how, k in self.retrievers}

    def run(self) -> DataFrame:
        lists = self.lists()
        if len(lists) == 1:
            out = next(iter(lists.values()))
        elif self.fuse_by == "weighted":
            out = fusion.weighted(lists, self.weights or dict.fromkeys(lists, 1.0), self.fuse_k)
        else:
            out = FUSIONS[self.fuse_by](lists, self.fuse_k)
        for step in self.rerankers:
            out = step(out)
        return out if self.final_k is None else out.filter(out["rank"] <= self.final_k)

    def evaluate(self, qrels: DataFrame, k: int = 10) -> DataFrame:
        return evaluation.binary_metrics(self.run(), qrels, k)
