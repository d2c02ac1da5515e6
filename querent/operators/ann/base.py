"""What all indexes share: packing, the bucketed search, and statistics.

An index is built from vectors (doc_id, embedding) and searched with queries (query_id, embedding); results are
query_id, doc_id, score (cosine), rank. Real ids are kept throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.topk import EXACT, ranked
from querent.runtime import materialize

#: Rows of a bucket that one task compares; larger buckets are dealt over several.
TASK_ROWS = 50_000
#: A fit on a sample takes at most so many vectors, those with the smallest hashes of their ids.
SAMPLE = 20_000


class AnnIndex(Protocol):
    def build(self, vectors: DataFrame) -> AnnIndex: ...

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


@dataclass(frozen=True)
class AnnStats:
    num_vectors: int
    dimension: int
    size_bytes: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(vectors: DataFrame, most: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, the same for the same rows in any order."""
    rows = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).select("embedding").collect()
    return unit(np.array([r[0] for r in rows], float)) if rows else np.zeros((0, 1))


def with_buckets(rows: DataFrame, id_col: str, assign) -> DataFrame:
    """(id, embedding, bucket) with a row for each bucket that assign(unit vectors) gives: an integer matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows:
                found = np.asarray(assign(unit(matrix(batch.column(1)))), np.int64)
                at = np.repeat(np.arange(len(found)), found.shape[1])
                yield pa.record_batch([batch.column(0).cast(pa.int64()).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(found.ravel())], names=[id_col, "embedding", "bucket"])

    return rows.select(id_col, F.col("embedding").cast("array<float>")).mapInArrow(run, f"{id_col} long, embedding array<float>, bucket long")


def bucket_search(docs: DataFrame, queries: DataFrame, k: int, task_rows: int = TASK_ROWS, compare=None) -> DataFrame:
    """The k most similar of ``docs`` (doc_id, embedding, bucket) that share a bucket with a query (query_id, embedding, bucket).

    A bucket's documents are dealt over as many tasks as its size asks for, each with all queries of the bucket; a task
    returns k rows a query. ``compare(queries, docs)`` gives the similarities of unit queries and of what ``embedding`` holds,
    such as codes; the cosine if not given.
    """
    sizes = materialize(docs.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(task_rows)).cast("int").alias("parts")), "buckets")
    dealt = docs.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    fresh = queries.select("query_id", F.col("embedding").alias("asked"), F.col("bucket").alias("place"))  # may stem from the same table
    asked = fresh.join(sizes, F.col("place") == F.col("bucket")).select("query_id", "asked", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, qids = (t.column(c).to_numpy() for t, c in ((left, "doc_id"), (right, "query_id")))
        x, q = (matrix(t.column(c).combine_chunks()) for t, c in ((left, "embedding"), (right, "asked")))
        x, q = unit(x) if compare is None else x, unit(q)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = []
        for i in range(0, len(q), 512):
            s = np.round(q[i : i + 512] @ x.T if compare is None else compare(q[i : i + 512], x), EXACT)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(qids[i : i + 512], top.shape[1]), ids[top.ravel()], np.take_along_axis(s, top, 1).ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    both = dealt.groupBy("bucket", "part").cogroup(asked.groupBy("place", "piece"))
    found = both.applyInArrow(run, "query_id long, doc_id long, score double")
    return ranked(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)
