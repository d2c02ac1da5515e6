"""Indexes by description, partitioners, and parameter tuning."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators import dense
from querent.operators.ann import kmeans
from querent.operators.ann.buckets import Annoy, ExactTree, Ivf, IvfPq, KMeansTree, Lsh, Scann
from querent.operators.ann.density import Layers
from querent.operators.ann.graphs import DiskAnn, Hnsw, Nsw, Sng, Vamana
from querent.operators.evaluation import neighbour_recall
from querent.runtime import materialize

NAMES = {"lsh": Lsh, "annoy": Annoy, "kmeans_tree": KMeansTree, "kd_tree": lambda **o: ExactTree("kd", **o), "ball_tree": lambda **o: ExactTree("ball", **o), "rp_tree": lambda **o: ExactTree("rp", **o), "sng": Sng, "vamana": Vamana, "diskann": DiskAnn, "hnsw": Hnsw, "nsw": Nsw, "ivf": Ivf, "ivf_pq": IvfPq, "scann": Scann}


def index_factory(dimension: int, text: str):
    """HNSW{m}[,{m_max}], NSW{m}, IVF{n},PQ{m}[x{bits}] (bits up to 16, m divides the dimension) or SCANN{n}."""
    if dimension < 1:
        raise InvalidParameter("the dimension must be positive")
    text = text.strip()
    number = lambda s: int(s) if int(s) > 0 else _refuse(f"{s} must be positive")
    if m := re.fullmatch(r"HNSW(\d+)(?:,(\d+))?", text):
        return Hnsw(degree=number(m[1]), m_max=number(m[2] or m[1]))
    if m := re.fullmatch(r"NSW(\d+)", text):
        return Nsw(degree=number(m[1]))
    if m := re.fullmatch(r"IVF(\d+),PQ(\d+)(?:x(\d+))?", text):
        n, books, bits = number(m[1]), number(m[2]), number(m[3] or "8")
        if dimension % books:
            raise InvalidParameter(f"{books} doesn't divide {dimension}")
        if bits > 16:
            raise InvalidParameter("codes have up to 16 bits")
        return IvfPq(clusters=n, nprobe=min(100, max(1, n // 10)), books=books, bits=bits)
    if m := re.fullmatch(r"SCANN(\d+)", text):
        return Scann(clusters=number(m[1]))
    raise InvalidParameter(f"unknown index {text!r}")


def _refuse(why: str):
    raise InvalidParameter(why)


class Partitioner(Protocol):
    def partition(self, vectors: DataFrame) -> DataFrame: ...


@dataclass
class KMeansPartitioner:
    clusters: int
    seed: int = 0

    def partition(self, vectors: DataFrame) -> DataFrame:
        """(doc_id, cluster)."""
        return kmeans.assign(vectors, kmeans.fit(vectors, self.clusters, seed=self.seed)).select("doc_id", "cluster")


@dataclass
class LayerPartitioner:
    layers: Layers

    def partition(self, vectors: DataFrame) -> DataFrame:
        """(doc_id, cluster); noise is a cluster of its own."""
        return self.layers.fit_predict(vectors)


@dataclass(frozen=True)
class Criterion:
    """kind recall: the cheapest parameter whose recall reaches ``least``; latency: the fastest that does; balanced: the
    largest recall less ``weight`` times seconds a query."""

    kind: str = "recall"
    k: int = 10
    least: float = 0.95
    weight: float = 1.0


@dataclass(frozen=True)
class Tuning:
    parameter: int
    recall: float
    seconds: float
    tried: tuple[tuple[int, float, float], ...]


@dataclass
class Tuner:
    """Tries values in rising order against exact neighbours of at most ``queries`` queries."""

    criterion: Criterion = Criterion()
    queries: int = 100
    budget: float | None = None

    def _tune(self, vectors: DataFrame, asked: DataFrame, search, values: list[int]) -> Tuning:
        some = materialize(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(self.queries), "tune")
        truth = materialize(dense.search_blocks(vectors, some, self.criterion.k), "tune")
        n, tried, began = max(1, some.count()), [], time.time()
        for v in sorted(set(values)):
            start = time.time()
            found = materialize(search(some, self.criterion.k, v), "tune")
            took = (time.time() - start) / n
            tried.append((v, float(neighbour_recall(truth, found, self.criterion.k).agg(F.avg("recall")).first()[0] or 0.0), took))
            if self.criterion.kind == "recall" and tried[-1][1] >= self.criterion.least or self.budget and time.time() - began > self.budget:
                break
        good = [t for t in tried if t[1] >= self.criterion.least]
        if self.criterion.kind == "balanced":
            best = max(tried, key=lambda t: t[1] - self.criterion.weight * t[2])
        elif good:
            best = min(good, key=lambda t: t[0] if self.criterion.kind == "recall" else t[2])
        else:
            best = max(tried, key=lambda t: t[1])
        return Tuning(*best, tuple(tried))

    def nprobe(self, vectors: DataFrame, asked: DataFrame, clusters: int, values: list[int]) -> Tuning:
        index = Ivf(clusters=clusters, nprobe=1).build(vectors)

        def search(some, k, v):
            index.nprobe = v
            index._ask()
            return index.search(some, k)

        return self._tune(vectors, asked, search, values)

    def ef(self, vectors: DataFrame, asked: DataFrame, values: list[int], **options) -> Tuning:
        index = Hnsw(**options).build(vectors)
        return self._tune(vectors, asked, lambda some, k, v: index.search(some, k, v), values)
