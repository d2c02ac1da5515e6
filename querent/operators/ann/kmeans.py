"""Spherical k-means: seeding on a bounded sample, Lloyd steps over all rows by partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.ann.base import matrix, sample, unit


def seeds(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++ on unit vectors by squared distance; fewer if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    if not k:
        return np.zeros((0, x.shape[1]))
    chosen = [int(rng.integers(len(x)))]
    far = 2 - 2 * x @ x[chosen[0]]
    while len(chosen) < k:
        weight = np.maximum(far, 0)
        at = int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        far = np.minimum(far, 2 - 2 * x @ x[at])
    return x[chosen].copy()


def lloyd(x: np.ndarray, k: int, steps: int = 25, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors in memory; an empty cluster keeps its centroid."""
    c = seeds(x, k, seed)
    for _ in range(steps):
        label = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        new = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), c)
        if np.abs(new - c).max() < 1e-6:
            return new
        c = new
    return c


def fit(vectors: DataFrame, k: int, steps: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids over all vectors: each step is one pass that returns k sums a partition."""
    c = lloyd(sample(vectors, seed=seed), k, 10, seed)
    rows = vectors.filter("embedding IS NOT NULL").select("embedding")
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(c)
            for batch in batches:
                x = unit(matrix(batch.column(0)))
                np.add.at(total, (x @ c.T).argmax(axis=1), x)
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        found = rows.mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v")).collect()  # k * dimension rows
        total = np.zeros(c.size)
        for at, v in found:
            total[at] = v
        total = total.reshape(c.shape)
        new = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-12, unit(total), c)
        if np.abs(new - c).max(initial=0) < 1e-6:
            return new
        c = new
    return c


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(doc_id, cluster, similarity) of the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = unit(matrix(batch.column(1))) @ centroids.T
            yield pa.record_batch([batch.column(0), pa.array(s.argmax(axis=1)), pa.array(np.round(s.max(axis=1), 6))], names=["doc_id", "cluster", "similarity"])

    return vectors.filter("embedding IS NOT NULL").select("doc_id", "embedding").mapInArrow(run, "doc_id long, cluster long, similarity double")
