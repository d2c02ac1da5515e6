"""Reranking of candidates: cosine, late interaction (MaxSim), token pooling, alignments, diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.functions.vectors import cosine, dot
from querent.operators.topk import best_of, ranked
from querent.runtime import spread


def rerank_cosine(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score (cosine), original_score, rank of candidates (query_id, doc_id, score); ``vectors``
    (doc_id, embedding), ``queries`` (query_id, embedding)."""
    rows = candidates.select("query_id", "doc_id", F.col("score").alias("original_score"))
    rows = rows.join(vectors.select("doc_id", "embedding"), "doc_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return ranked(rows.select("query_id", "doc_id", cosine("embedding", "q").alias("score"), "original_score"), k)


def rerank_with(candidates: DataFrame, docs: DataFrame, queries: DataFrame, scorer, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score, original_score, rank by a cross-encoder: ``scorer(query texts, document texts)`` gives a score for each
    pair, in batches. ``docs`` (doc_id, text), ``queries`` (query_id, text); null texts are empty."""
    rows = candidates.select("query_id", "doc_id", F.col("score").alias("original_score"))
    rows = rows.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("d")), "doc_id").join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("q")), "query_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["query_id", "doc_id", "original_score"]].assign(score=np.asarray(scorer(list(f["q"]), list(f["d"])), float))

    kind = rows.schema
    scored = rows.mapInPandas(run, f"query_id {kind['query_id'].dataType.simpleString()}, doc_id {kind['doc_id'].dataType.simpleString()}, original_score double, score double")
    return ranked(scored.select("query_id", "doc_id", "score", "original_score"), k)


def maxsim(query: str | Column, doc: str | Column, similarity=dot) -> Column:
    """Sum over query tokens of the largest similarity with a document token; 0 if either side is empty."""
    q, d = (F.col(c) if isinstance(c, str) else c for c in (query, doc))
    best = F.transform(q, lambda t: F.coalesce(F.array_max(F.transform(d, lambda u: similarity(t, u))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v)


def maxsim_cosine(query: str | Column, doc: str | Column) -> Column:
    return maxsim(query, doc, cosine)


#: Documents and queries of a block, about, and queries that are compared at a time.
BLOCK, ASKED, TILE = 512, 512, 64


def _token_blocks(rows: DataFrame, most: int) -> DataFrame:
    """(ids, data, n, tokens, dim): matrices (id, tokens) in blocks of up to ``most`` rows; data has each row's tokens one behind the
    other, as little-endian doubles, filled up with zeros to the block's number of tokens (sizes has the true ones) and of components."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                lists = part.column(1)
                sizes = np.where(lists.is_null(), 0, pc.fill_null(pc.list_value_length(lists), 0)).astype("<i4")
                tokens = lists.flatten()
                width = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(int)
                # A token that is null or holds a null has no similarity: it is left out.
                flat = tokens.flatten()
                value = np.zeros((len(tokens), max(1, int(width.max(initial=0)))))
                row = np.repeat(np.arange(len(tokens)), width)
                value[row, np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
                good = tokens.is_valid().to_numpy(zero_copy_only=False)
                good[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
                owner = np.repeat(np.arange(part.num_rows), sizes)[good]
                sizes = np.bincount(owner, minlength=part.num_rows).astype("<i4")
                out = np.zeros((part.num_rows, max(1, int(sizes.max(initial=0))), value.shape[1]), "<f8")
                out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = value[good]
                yield pa.record_batch([pa.array([part.column(0)], pa.list_(part.column(0).type)), pa.array([sizes.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary()), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[2]], pa.int32())], names=["ids", "sizes", "data", "tokens", "dim"])

    return rows.mapInArrow(run, f"ids array<{kind}>, sizes binary, data binary, tokens int, dim int")


def maxsim_matrix(q: np.ndarray, d: np.ndarray, q_sizes: np.ndarray, d_sizes: np.ndarray) -> np.ndarray:
    """MaxSim of every query and every document, (rows, tokens, components) both with their numbers of tokens; 0 if either is empty.
    Of unequal numbers of components the common ones count."""
    dim = min(q.shape[2], d.shape[2])
    places = [np.ascontiguousarray(d[:, j, :dim].T) for j in range(d.shape[1])]
    whole = [None if (d_sizes > j).all() else d_sizes > j for j in range(d.shape[1])]
    total = np.zeros((len(q), len(d)))
    one, best = np.empty_like(total), np.empty_like(total)
    for i in range(q.shape[1]):
        own = np.ascontiguousarray(q[:, i, :dim])
        best.fill(-np.inf)
        for place, some in zip(places, whole, strict=True):
            np.matmul(own, place, out=one)
            np.maximum(best, one, out=best, **({} if some is None else {"where": some[None, :]}))
        np.add(total, best, out=total, where=(q_sizes > i)[:, None])
    total[:, d_sizes == 0] = 0.0
    return total


def rank_maxsim(queries: DataFrame, docs: DataFrame, candidates: DataFrame | None = None, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score, rank by MaxSim of token matrices: ``queries`` (query_id, tokens), ``docs`` (doc_id, tokens).
    Without candidates every document is scored against the stated queries: blocks of both meet, and a pair of blocks returns
    k rows a query."""
    if candidates is not None or k is None:
        q = queries.select("query_id", F.col("tokens").alias("q"))
        d = spread(docs.select("doc_id", F.col("tokens").alias("d")))
        pairs = q.crossJoin(d) if candidates is None else candidates.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id")
        return ranked(pairs.select("query_id", "doc_id", maxsim("q", "d").alias("score")), k)
    form = F.col("tokens").cast("array<array<double>>")
    base = _token_blocks(spread(docs.select("doc_id", form)), BLOCK)
    asked = _token_blocks(queries.select("query_id", form), ASKED)
    kinds = (base.schema["ids"].dataType.elementType.simpleString(), asked.schema["ids"].dataType.elementType.simpleString())
    names = base.columns
    pairs = base.crossJoin(asked.toDF(*[f"q_{c}" for c in names]))  # a stated query set against all rows, in blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                order = pc.sort_indices(row["ids"].values, null_placement="at_start")
                ids, qids, at = row["ids"].values.take(order), row["q_ids"].values, order.to_numpy()
                matrix = lambda p: np.frombuffer(row[f"{p}data"].as_py(), "<f8").reshape(-1, row[f"{p}tokens"].as_py(), row[f"{p}dim"].as_py())  # noqa: B023, E731
                d, q = matrix("")[at], matrix("q_")
                sizes, q_sizes = np.frombuffer(row["sizes"].as_py(), "<i4")[at], np.frombuffer(row["q_sizes"].as_py(), "<i4")
                for i in range(0, len(q), TILE):
                    s = maxsim_matrix(q[i : i + TILE], d, q_sizes[i : i + TILE], sizes)
                    mine, top, score = best_of(s, k)
                    yield pa.record_batch([qids.slice(i, TILE).take(pa.array(mine)), ids.take(pa.array(top)), pa.array(score)], names=["query_id", "doc_id", "score"])

    return ranked(pairs.mapInArrow(run, f"query_id {kinds[1]}, doc_id {kinds[0]}, score double"), k)


def alignments(query: str | Column, doc: str | Column) -> Column:
    """For each query token (q, d, score): the document token of the largest dot product, of ties the first."""
    q, d = (F.col(c) if isinstance(c, str) else c for c in (query, doc))
    pairs = lambda t: F.array_max(F.transform(d, lambda u, j: F.struct(dot(t, u).alias("score"), (-j).alias("minus_d"))))
    return F.transform(q, lambda t, i: F.struct(i.alias("q"), (-pairs(t)["minus_d"]).alias("d"), pairs(t)["score"].alias("score")))


def highlight(query: str | Column, doc: str | Column, threshold: float) -> Column:
    """Sorted positions of document tokens whose largest dot product with a query token reaches the threshold."""
    q, d = (F.col(c) if isinstance(c, str) else c for c in (query, doc))
    best = F.transform(d, lambda u, j: F.struct(j.alias("j"), F.array_max(F.transform(q, lambda t: dot(t, u))).alias("s")))
    return F.transform(F.filter(best, lambda x: x["s"] >= threshold), lambda x: x["j"])


def pool_tokens(tokens: str | Column, factor: int) -> Column:
    """Means of ``factor`` successive token vectors: about 1/factor as many; factor 1 keeps all."""
    if factor < 1:
        raise InvalidParameter("factor must be at least 1")
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if factor == 1:
        return t
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / factor).cast("int")), lambda g: F.slice(t, g * factor + 1, factor))
    mean = lambda g: F.transform(g[0], lambda _, i: F.aggregate(g, F.lit(0.0), lambda acc, v: acc + F.get(v, i).cast("double")) / F.size(g))
    return F.when(F.size(t) == 0, F.transform(t, lambda v: F.transform(v, lambda x: x.cast("double")))).otherwise(F.transform(groups, mean))


def pool_tokens_clustered(docs: DataFrame, factor: int) -> DataFrame:
    """(doc_id, tokens) with the tokens merged to ceil(n / factor) means, the nearest (by cosine) pair at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(tokens=[_merged(np.array(list(map(list, t)), float), factor) for t in f["tokens"]])

    return docs.select("doc_id", "tokens").mapInPandas(run, "doc_id long, tokens array<array<double>>")


def _merged(x: np.ndarray, factor: int) -> list:
    groups = [[i] for i in range(len(x))]
    while len(groups) > max(1, -(-len(x) // factor)):
        m = np.stack([x[g].mean(axis=0) for g in groups])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = m @ m.T
        s[np.tril_indices(len(s))] = -np.inf
        i, j = np.unravel_index(s.argmax(), s.shape)
        groups[i] += groups.pop(j)
    return [x[g].mean(axis=0).tolist() for g in groups]


def diversify(candidates: DataFrame, vectors: DataFrame, k: int = 10, trade: float = 0.5) -> DataFrame:
    """query_id, doc_id, score, rank by maximal marginal relevance among each query's candidates (query_id, doc_id, score).

    A query's candidates are a result list, so a group is as long as the list that was asked for.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id").reset_index(drop=True)
        x = np.array(list(f["embedding"]), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rest, near, out = list(range(len(f))), np.zeros(len(f)), []
        while rest and len(out) < k:
            value = [trade * f["score"][i] - (1 - trade) * (near[i] if out else 0.0) for i in rest]
            i = rest.pop(int(np.argmax(value)))
            out.append((f["query_id"][0], f["doc_id"][i], max(value), len(out) + 1))
            near = np.maximum(near, x @ x[i]) if len(out) > 1 else x @ x[i]
        return pd.DataFrame(out, columns=["query_id", "doc_id", "score", "rank"])

    rows = candidates.select("query_id", "doc_id", "score").join(vectors.select("doc_id", "embedding"), "doc_id")
    return rows.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, score double, rank int")
