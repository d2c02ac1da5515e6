"""Quantizers: product (plain, optimised, online), scalar after rotation, and segments with bits by variance.

Fitted on bounded samples in memory; ``encode`` and ``adc_search`` run over all rows in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import DimensionMismatch, InvalidParameter
from querent.operators.ann.base import matrix, sample, unit
from querent.operators.topk import EXACT, ranked


def _kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """Euclidean k-means in memory."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(steps):
        label = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(label, minlength=len(c))
        np.add.at(sums, label, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class ProductQuantizer:
    """Codebooks for equal slices of the dimensions."""

    dimension: int
    books: int = 8
    codes: int = 256
    steps: int = 15
    seed: int = 0
    codebooks: list[np.ndarray] = field(default_factory=list, repr=False)

    def __post_init__(self):
        if self.books < 1 or self.dimension % self.books:
            raise InvalidParameter(f"{self.dimension} dimensions can't be cut into {self.books} equal parts")

    def parts(self, x: np.ndarray) -> np.ndarray:
        if x.shape[-1] != self.dimension:
            raise DimensionMismatch(f"{x.shape[-1]} is not {self.dimension}")
        return x.reshape(len(x), self.books, -1)

    def fit(self, x: np.ndarray) -> ProductQuantizer:
        p = self.parts(x)
        self.codebooks = [_kmeans(p[:, b], self.codes, self.steps, self.seed + b) for b in range(self.books)]
        return self

    def quantize(self, x: np.ndarray) -> np.ndarray:
        p = self.parts(x)
        return np.stack([((c * c).sum(1) - 2 * p[:, b] @ c.T).argmin(axis=1) for b, c in enumerate(self.codebooks)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, b]] for b, c in enumerate(self.codebooks)], axis=1)

    def similarities(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate dot products (queries, codes): sums of table entries."""
        q = self.parts(queries)
        return sum(((q[:, b] @ c.T)[:, codes[:, b]] for b, c in enumerate(self.codebooks)), np.zeros((1, 1)))

    def approximate_distance(self, query: np.ndarray, code: np.ndarray) -> float:
        return float(1 - self.similarities(query[None], code[None])[0, 0])


@dataclass
class AnisotropicQuantizer(ProductQuantizer):
    """Codes that weigh the part of the error that is parallel to the vector ``parallel`` times as much as the rest, as it is
    that part which moves large products; chosen book by book in ``sweeps`` over a plain code."""

    parallel: float = 4.0
    sweeps: int = 2
    turns: int = 3

    def fit(self, x: np.ndarray) -> AnisotropicQuantizer:
        """Plain codebooks, then in turns codes and the codewords that are best for them (weighted least squares)."""
        super().fit(x)
        p, more = self.parts(x), self.parallel - 1
        for _ in range(self.turns):
            codes = self.quantize(x)
            along = np.stack([((p[:, b] - c[codes[:, b]]) * p[:, b]).sum(axis=1) for b, c in enumerate(self.codebooks)])
            for b, c in enumerate(self.codebooks):
                target = along.sum(axis=0) - along[b] + (p[:, b] * p[:, b]).sum(axis=1)
                for i in np.unique(codes[:, b]):
                    rows = codes[:, b] == i
                    y = p[rows, b]
                    c[i] = np.linalg.solve(rows.sum() * np.eye(y.shape[1]) + more * y.T @ y, y.sum(axis=0) + more * target[rows] @ y)
                along[b] = ((p[:, b] - c[codes[:, b]]) * p[:, b]).sum(axis=1)
        return self

    def quantize(self, x: np.ndarray) -> np.ndarray:
        codes, p = super().quantize(x), self.parts(x)
        along = np.stack([((p[:, b] - c[codes[:, b]]) * p[:, b]).sum(axis=1) for b, c in enumerate(self.codebooks)])
        length = np.maximum((x * x).sum(axis=1, keepdims=True), 1e-30)
        for _ in range(self.sweeps):
            for b, c in enumerate(self.codebooks):
                others = along.sum(axis=0) - along[b]
                own = (p[:, b] * p[:, b]).sum(axis=1, keepdims=True) - p[:, b] @ c.T
                error = (c * c).sum(axis=1) - 2 * p[:, b] @ c.T
                loss = error + (self.parallel - 1) * (others[:, None] + own) ** 2 / length
                codes[:, b] = loss.argmin(axis=1)
                along[b] = own[np.arange(len(x)), codes[:, b]]
        return codes


@dataclass
class OptimizedProductQuantizer(ProductQuantizer):
    """A rotation before the slices, improved in turns with the codebooks (orthogonal Procrustes)."""

    turns: int = 5
    rotation: np.ndarray | None = field(default=None, repr=False)

    def fit(self, x: np.ndarray) -> OptimizedProductQuantizer:
        self.rotation = np.linalg.eigh(x.T @ x)[1]
        order = np.argsort(np.arange(self.dimension) % self.books, kind="stable")  # spreads the variance over slices
        self.rotation = self.rotation[:, order]
        for _ in range(self.turns):
            y = x @ self.rotation
            super().fit(y)
            u, _, vt = np.linalg.svd(x.T @ super().decode(super().quantize(y)))
            self.rotation = u @ vt
        super().fit(x @ self.rotation)
        return self

    def quantize(self, x: np.ndarray) -> np.ndarray:
        return super().quantize(x @ self.rotation)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return super().decode(codes) @ self.rotation.T

    def similarities(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return super().similarities(queries @ self.rotation, codes)


@dataclass
class OnlineProductQuantizer(ProductQuantizer):
    """Codebooks that follow a stream: an assigned codeword moves towards its vector, the weights of others fade."""

    rate: float = 0.05
    forget: float = 0.1
    counts: np.ndarray | None = field(default=None, repr=False)

    def initialize(self, x: np.ndarray) -> OnlineProductQuantizer:
        self.fit(x)
        codes = self.quantize(x)
        self.counts = np.stack([np.bincount(codes[:, b], minlength=len(c)) for b, c in enumerate(self.codebooks)]).astype(float)
        return self

    def update_batch(self, x: np.ndarray) -> OnlineProductQuantizer:
        """Move every codeword towards the mean of the vectors assigned to it, as far as that many single steps would; codewords
        that have faded, being assigned to none for long, start again at the vector that is worst coded."""
        codes, p = self.quantize(x), self.parts(x)
        for b, c in enumerate(self.codebooks):
            n = np.bincount(codes[:, b], minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, codes[:, b], p[:, b])
            step = 1 - (1 - self.rate) ** n
            c += step[:, None] * (sums / np.maximum(n, 1)[:, None] - c)
            self.counts[b] = self.counts[b] * (1 - 0.01 * self.forget) ** len(x) + n
            worst = np.argsort(-((p[:, b] - c[codes[:, b]]) ** 2).sum(axis=1), kind="stable")
            for i, at in zip(np.nonzero(self.counts[b] < 1e-3)[0], worst, strict=False):
                c[i], self.counts[b, i] = p[at, b], 1.0
        return self


@dataclass
class TurboQuantizer:
    """A seeded rotation, then 2**bits equal steps between each coordinate's smallest and largest value."""

    dimension: int
    bits: int = 8
    seed: int = 0
    rotation: np.ndarray | None = field(default=None, repr=False)
    low: np.ndarray | None = field(default=None, repr=False)
    step: np.ndarray | None = field(default=None, repr=False)

    def fit(self, x: np.ndarray) -> TurboQuantizer:
        self.rotation = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((self.dimension, self.dimension)))[0]
        y = x @ self.rotation
        self.low, high = y.min(axis=0), y.max(axis=0)
        self.step = np.maximum((high - self.low) / (1 << self.bits), 1e-12)
        return self

    def quantize(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x @ self.rotation - self.low) / self.step), 0, (1 << self.bits) - 1).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return (self.low + (codes + 0.5) * self.step) @ self.rotation.T

    def similarities(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return queries @ self.decode(codes).T


@dataclass
class SaqQuantizer:
    """Segments of the dimensions with bits in proportion to their share of the variance, at least one each."""

    dimension: int
    segments: int = 8
    bits: int = 48
    seed: int = 0
    most: int = 10
    allotted: list[int] = field(default_factory=list)
    codebooks: list[np.ndarray] = field(default_factory=list, repr=False)

    def fit(self, x: np.ndarray) -> SaqQuantizer:
        self.edges = np.linspace(0, self.dimension, self.segments + 1).astype(int)
        variance = np.array([x[:, a:b].var(axis=0).sum() for a, b in zip(self.edges, self.edges[1:], strict=False)])
        share = self.bits * variance / max(variance.sum(), 1e-30)
        self.allotted = [int(min(self.most, max(1, np.floor(s)))) for s in share]
        for i in np.argsort(-(share - np.floor(share)), kind="stable"):
            if sum(self.allotted) < self.bits and self.allotted[i] < self.most:
                self.allotted[i] += 1
        cut = zip(self.edges, self.edges[1:], strict=False)
        self.codebooks = [_kmeans(x[:, a:b], 1 << n, 10, self.seed) for (a, b), n in zip(cut, self.allotted, strict=True)]
        return self

    def _slices(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def quantize(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((c * c).sum(1) - 2 * p @ c.T).argmin(axis=1) for p, c in zip(self._slices(x), self.codebooks, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, b]] for b, c in enumerate(self.codebooks)], axis=1)

    def similarities(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(((q @ c.T)[:, codes[:, b]] for b, (q, c) in enumerate(zip(self._slices(queries), self.codebooks, strict=True))), np.zeros((1, 1)))


def encode(vectors: DataFrame, quantizer) -> DataFrame:
    """(doc_id, codes array<int>) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = quantizer.quantize(unit(matrix(batch.column(1)))).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(list(codes), pa.list_(pa.int32()))], names=["doc_id", "codes"])

    return vectors.filter("embedding IS NOT NULL").select("doc_id", "embedding").mapInArrow(run, "doc_id long, codes array<int>")


def adc_search(codes: DataFrame, queries: DataFrame, quantizer, k: int, task_rows: int = 20_000) -> DataFrame:
    """query_id, doc_id, score, rank by approximate similarity: blocks of codes against blocks of queries."""
    parts = max(1, -(-codes.count() // task_rows))
    packed = codes.select("doc_id", "codes").repartition(parts).mapInArrow(_pack_codes, "ids binary, data binary, width int")
    from querent.operators.dense import packed as pack

    asked = pack(queries.select("query_id", "embedding"), 256).withColumnRenamed("ids", "qids").withColumnRenamed("data", "qdata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, width, qids, qdata in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                c, q = np.frombuffer(data, "<u2").reshape(-1, width), unit(np.frombuffer(qdata, "<f8").reshape(len(qids), -1))
                order = np.argsort(ids, kind="stable")
                s = np.round(quantizer.similarities(q, c[order]), EXACT)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pa.record_batch([pa.array(np.repeat(qids, top.shape[1])), pa.array(ids[order][top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query_id", "doc_id", "score"])

    return ranked(packed.crossJoin(asked).mapInArrow(run, "query_id long, doc_id long, score double"), k)


def _pack_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([batch.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([flat.astype("<u2").tobytes()], pa.binary()), pa.array([len(flat) // batch.num_rows], pa.int32())], names=["ids", "data", "width"])


def search_reranked(vectors: DataFrame, queries: DataFrame, quantizer, k: int = 10, first: int = 200) -> DataFrame:
    """The ``first`` by approximate similarity, rescored exactly."""
    from querent.operators.rerank import rerank_cosine

    found = adc_search(encode(vectors, quantizer), queries, quantizer, first)
    return rerank_cosine(found, vectors, queries, k).drop("original_score")


def fitted(vectors: DataFrame, quantizer):
    """The quantizer, fitted on a bounded sample."""
    return quantizer.fit(sample(vectors))


def covariance(vectors: DataFrame) -> DataFrame:
    """(i, j, value): second moments of the components, by one pass of column expressions."""
    cells = F.explode(F.flatten(F.transform("embedding", lambda a, i: F.transform("embedding", lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a.cast("double") * b.cast("double")).alias("v"))))))
    return vectors.select(cells.alias("c")).groupBy("c.i", "c.j").agg(F.avg("c.v").alias("value"))
