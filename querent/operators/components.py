"""Connected components of a graph too large for one machine, by alternating star contractions.

Each round hangs every node's larger neighbours below the smallest node it knows (large star), then its smaller
ones (small star); after a logarithmic number of rounds every node hangs below its component's smallest node.
Rounds work on tables in the shared folder, so lost executors cost a re-read, and joins are between plain
tables, so Spark splits a node with very many neighbours over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.runtime import materialize

SCHEMA = "hi long, lo long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each can reach) for the edges (a[i], b[i])."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)  # hang the roots themselves below smaller ones
        np.minimum.at(new, label[y], least)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch of edges, as stars."""
    for batch in batches:
        nodes, low = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != low
        yield pa.record_batch([pa.array(nodes[keep]), pa.array(low[keep])], names=["hi", "lo"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(a_b: DataFrame) -> DataFrame:
    """(node, component) from edges in the first two columns; component is the smallest node reachable.

    Loops, repeated edges and both directions of an edge are fine; nodes without edges to others don't appear,
    and rows with a null end are ignored.
    """
    x, y = (F.col(f"`{c}`").cast("long") for c in a_b.columns[:2])
    edges = a_b.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), x.alias("x"), y.alias("y")).filter("hi > lo AND x IS NOT NULL AND y IS NOT NULL")
    edges = materialize(edges.select("hi", "lo").mapInArrow(_contracted, SCHEMA).distinct(), "cc")
    state = _state(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "cc")
        larger = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u")
        own = least.select(F.col("u").alias("hi"), F.col("m").alias("lo")).filter("lo < hi")  # a node's own smallest neighbour
        large = larger.select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).union(own).filter("hi > lo").distinct()
        edges = materialize(large, "cc")
        least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("m")), "cc")
        hung = edges.join(least, "hi")
        small = hung.select(F.col("lo").alias("a"), F.col("m").alias("b")).union(least.select("hi", "m")).filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
        edges = materialize(small, "cc")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
