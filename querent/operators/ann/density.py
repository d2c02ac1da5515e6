"""Single-linkage clustering in layers, duplicates, and dimensionality reduction.

Links at falling cosine thresholds are found in blocks, each block pair returning a spanning forest of its links, and
components give the clusters of each layer; layers nest, so they form the tree of merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators.ann.base import unit
from querent.operators.components import components, roots
from querent.operators.dense import packed
from querent.runtime import materialize

THRESHOLDS = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5)


def projection(dimension: int, target: int, seed: int = 0) -> np.ndarray:
    """A seeded random projection with unit columns."""
    if not 0 < target < dimension:
        raise InvalidParameter("the target must be below the dimension")
    p = np.random.default_rng(seed).uniform(-1, 1, (dimension, target))
    return p / np.linalg.norm(p, axis=0)


def reduce(vectors: DataFrame, target: int = 15, seed: int = 0) -> DataFrame:
    """(doc_id, embedding) with ``target`` dimensions."""
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    p = projection(dim, target, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, dim) @ p
            yield pa.record_batch([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "embedding"])

    return vectors.filter("embedding IS NOT NULL").select("doc_id", "embedding").mapInArrow(run, "doc_id long, embedding array<double>")


def linked(vectors: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, a, b): forests of the links of cosine >= threshold, by pairs of blocks."""
    one = packed(vectors.select("doc_id", "embedding"))
    two = one.withColumnRenamed("ids", "ids2").withColumnRenamed("data", "data2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                if a[0] > b[0]:
                    continue
                s = unit(np.frombuffer(x, "<f8").reshape(len(a), -1)) @ unit(np.frombuffer(y, "<f8").reshape(len(b), -1)).T
                for t in thresholds:
                    i, j = np.nonzero(s >= t - 1e-9)
                    nodes, low = roots(a[i], b[j])
                    keep = nodes != low
                    yield pa.record_batch([pa.array(np.full(keep.sum(), t)), pa.array(nodes[keep]), pa.array(low[keep])], names=["threshold", "a", "b"])

    return one.crossJoin(two).mapInArrow(run, "threshold double, a long, b long")


@dataclass
class Layers:
    """Clusters of at least ``least`` members at each threshold."""

    dimension: int = 15
    least: int = 10
    thresholds: tuple[float, ...] = THRESHOLDS
    seed: int = 0

    def fit(self, vectors: DataFrame) -> DataFrame:
        """(threshold, doc_id, cluster): cluster is the smallest id of its members, -1 for noise."""
        links = materialize(linked(reduce(vectors, self.dimension, self.seed), self.thresholds), "layers")
        every = vectors.filter("embedding IS NOT NULL").select("doc_id")
        out = None
        for t in self.thresholds:
            group = components(links.filter(F.col("threshold") == t).select("a", "b"))
            sizes = group.groupBy("component").agg(F.count("*").alias("n"))
            named = group.join(sizes, "component").filter(F.col("n") >= self.least)
            layer = every.join(named.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
            layer = layer.select(F.lit(t).alias("threshold"), "doc_id", F.coalesce("component", F.lit(-1)).alias("cluster"))
            out = layer if out is None else out.unionByName(layer)
        return out

    def fit_predict(self, vectors: DataFrame) -> DataFrame:
        """(doc_id, cluster) of the layer with the most clusters, of ties the one of the highest threshold."""
        layers = materialize(self.fit(vectors), "layers")
        counts = layers.filter("cluster >= 0").groupBy("threshold").agg(F.countDistinct("cluster").alias("n")).collect()  # one row a threshold
        best = max(((r["n"], r["threshold"]) for r in counts), default=(0, self.thresholds[0]))[1]
        return layers.filter(F.col("threshold") == best).select("doc_id", "cluster")


def merge_tree(layers: DataFrame) -> DataFrame:
    """(threshold, cluster, parent, parent_threshold, size): which cluster of the next lower threshold holds each cluster.

    ``layers`` is the result of ``Layers.fit``; layers nest, so any member tells the parent.
    """
    some = layers.filter("cluster >= 0")
    sizes = some.groupBy("threshold", "cluster").agg(F.count("*").alias("size"), F.min("doc_id").alias("member"))
    steps = layers.select("threshold").distinct().alias("a")
    lower = layers.select(F.col("threshold").alias("t")).distinct().alias("b")
    next_ = steps.join(lower, F.col("b.t") < F.col("a.threshold")).groupBy("a.threshold").agg(F.max("b.t").alias("parent_threshold"))
    up = some.select(F.col("threshold").alias("parent_threshold"), F.col("doc_id").alias("member"), F.col("cluster").alias("parent"))
    return sizes.join(next_, "threshold", "left").join(up, ["parent_threshold", "member"], "left").select("threshold", "cluster", "parent", "parent_threshold", "size")


#: Random directions that ``duplicates`` lays its grid along.
DIRECTIONS = 6


def duplicates(vectors: DataFrame, distance: float = 1e-6, seed: int = 0) -> DataFrame:
    """(doc_id, group): groups of vectors nearer than ``distance`` in cosine distance, named by the smallest id.

    Unit vectors so near lie within sqrt(2 * distance) of each other along any direction. So each distinct vector is posted in
    its cell of a grid along random directions, and in the neighbouring cells that are as near; those that share a cell
    are compared. Nothing is missed, and vectors that aren't near hardly ever meet.
    """
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    ways = projection(dim + DIRECTIONS, DIRECTIONS, seed)[:dim]
    ways = ways / np.linalg.norm(ways, axis=0)
    reach = float(np.sqrt(2 * distance)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)) + 0.0
            at = x @ ways / (4 * reach)
            cell, part = np.floor(at), at - np.floor(at)
            near = np.where(part < 0.25, -1, np.where(part > 0.75, 1, 0)).astype(np.int64)
            cells = [[c.tobytes()] for c in cell.astype("<i8")]
            for i in range(batch.num_rows):
                for pick in range(1, 1 << DIRECTIONS):
                    move = np.array([near[i, k] if pick >> k & 1 else 0 for k in range(DIRECTIONS)])
                    if all(move[k] for k in range(DIRECTIONS) if pick >> k & 1):
                        cells[i].append((cell[i].astype("<i8") + move).tobytes())
            yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in x.round(12)], pa.binary()), pa.array(list(x), pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.binary()))], names=["doc_id", "same", "x", "cells"])

    rows = vectors.filter("embedding IS NOT NULL").select(F.col("doc_id").cast("long"), "embedding").mapInArrow(run, "doc_id long, same binary, x array<double>, cells array<binary>")
    rows = materialize(rows, "duplicates")
    low = rows.groupBy("same").agg(F.min("doc_id").alias("low"))
    equal = rows.join(low, "same").select("doc_id", "low")  # equal vectors hang below the smallest id, so they make no pairs
    posted = rows.join(low.select(F.col("low").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "x", F.explode("cells").alias("cell"))
    a, b = posted.alias("a"), posted.alias("b")
    cosine = F.aggregate(F.zip_with("a.x", "b.x", lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.doc_id") < F.col("b.doc_id"))).filter(cosine >= 1 - distance)
    links = pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).unionByName(equal.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    return components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
