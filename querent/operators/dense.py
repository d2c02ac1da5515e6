"""Exact dense retrieval and its metadata filters.

Two forms of the same search: ``retrieve`` for a few driver-side queries in column expressions, and ``search_blocks``
for many queries, in blocks of vectors compared by matrix products. Filters are applied before the search, so a
filtered search never returns fewer rows than it could.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.errors import DimensionMismatch, InvalidParameter, RetrievalError
from querent.functions.vectors import dot
from querent.operators.topk import EXACT, ranked

BLOCK = 2048


def retrieve(vectors: DataFrame, queries: dict[int, Sequence[float]], k: int | None = 10, where: Column | None = None, strict: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of the largest positive dot products with ``vectors`` (doc_id, embedding).

    ``where`` filters the vectors first; ``strict`` raises if a query then has fewer than k results.
    """
    if not queries:
        raise InvalidParameter("no queries")
    rows = vectors if where is None else vectors.filter(where)
    asked = F.explode(F.array(*[F.struct(F.lit(int(i)).cast("long").alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for i, v in queries.items()]))
    scores = rows.select("doc_id", "embedding", asked.alias("a")).select("a.query_id", "doc_id", dot("embedding", "a.q").alias("score"))
    found = ranked(scores.filter("score > 0 AND NOT isnan(score)"), k)
    if strict and k is not None:
        counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
        if any(counts.get(int(i), 0) < k for i in queries):
            raise RetrievalError(f"a query has fewer than {k} results under the filter")
    return found


def score(vectors: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, score (dot product) of every query (query_id, embedding) and every one of ``docs`` (doc_id), stated sets both."""
    rows = vectors.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "embedding")
    pairs = rows.crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    return pairs.select("query_id", "doc_id", F.round(dot("embedding", "q"), 6).alias("score"))


def packed(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(ids, data): vectors (id, embedding) in blocks of little-endian doubles; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                if len(flat) % part.num_rows:
                    raise DimensionMismatch("vectors of unequal length")
                yield pa.record_batch([pa.array([part.column(0).cast(pa.int64()).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["ids", "data"])

    return vectors.mapInArrow(run, "ids binary, data binary")


def search_blocks(vectors: DataFrame, queries: DataFrame, k: int = 10, unit: bool = True, exclude_self: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: for every query (query_id, embedding) the k rows of ``vectors`` (doc_id, embedding)
    with the largest cosine (or dot product, unless ``unit``). Blocks of queries meet blocks of vectors; a pair of
    blocks returns k rows a query at most, so what is shuffled is k rows a query and block."""
    base = packed(vectors.select("doc_id", "embedding"))
    asked = packed(queries.select("query_id", "embedding"), 512).withColumnRenamed("ids", "qids").withColumnRenamed("data", "qdata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, qids, qdata in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                x, q = np.frombuffer(data, "<f8").reshape(len(ids), -1), np.frombuffer(qdata, "<f8").reshape(len(qids), -1)
                if x.shape[1] != q.shape[1]:
                    raise DimensionMismatch(f"{q.shape[1]} is not {x.shape[1]}")
                if unit:
                    x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30) for v in (x, q))
                s = np.round(q @ x.T, EXACT)
                if exclude_self:
                    s[qids[:, None] == ids[None, :]] = -np.inf
                order = np.argsort(ids, kind="stable")
                s, ids = s[:, order], ids[order]
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, top, axis=1).ravel()
                good = np.isfinite(score)
                yield pa.record_batch([pa.array(np.repeat(qids, top.shape[1])[good]), pa.array(ids[top.ravel()][good]), pa.array(score[good])], names=["query_id", "doc_id", "score"])

    pairs = base.crossJoin(asked)  # a stated query set against all rows, in blocks
    return ranked(pairs.mapInArrow(run, "query_id long, doc_id long, score double"), k)


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, distance (1 - cosine), rank: exact neighbours by ascending distance."""
    return search_blocks(vectors, queries, k).select("query_id", "doc_id", F.round(1 - F.col("score"), 6).alias("distance"), "rank")


def cached_answers(cache: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """query_id, hit, response, score: the answer stored for the most similar vector of ``cache`` (doc_id, embedding,
    response), a hit if the cosine is at least ``threshold``; response is null otherwise."""
    best = search_blocks(cache.select("doc_id", "embedding"), queries, 1).join(cache.select("doc_id", "response"), "doc_id")
    out = queries.select("query_id").join(best, "query_id", "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select("query_id", hit.alias("hit"), F.when(hit, F.col("response")).alias("response"), "score")
