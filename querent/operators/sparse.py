"""Sparse vectors: a struct of parallel arrays, indices sorted and unique."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators.topk import best_of, ranked
from querent.runtime import materialize, spread

TINY = 1e-9


def is_valid(indices: str | Column, values: str | Column) -> Column:
    """Equal lengths, indices strictly ascending."""
    i, v = (F.col(c) if isinstance(c, str) else c for c in (indices, values))
    return (F.size(i) == F.size(v)) & (i == F.array_sort(F.array_distinct(i)))


def _zipped(indices: Column | str, values: Column | str) -> Column:
    i, v = (F.col(c) if isinstance(c, str) else c for c in (indices, values))
    return F.zip_with(i, v, lambda a, b: F.struct(a.alias("i"), b.cast("double").alias("v")))


def _split(pairs: Column) -> Column:
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values"))


def prune(indices, values, threshold: float) -> Column:
    """Entries of at least this absolute value."""
    return _split(F.filter(_zipped(indices, values), lambda p: F.abs(p["v"]) >= threshold))


def top(indices, values, k: int) -> Column:
    """The k entries of the largest absolute values (of ties the smaller index), in the order of indices."""
    by_size = F.array_sort(F.transform(_zipped(indices, values), lambda p: F.struct((-F.abs(p["v"])).alias("a"), p["i"].alias("i"), p["v"].alias("v"))))
    return _split(F.array_sort(F.transform(F.slice(by_size, 1, k), lambda p: F.struct(p["i"].alias("i"), p["v"].alias("v")))))


def norm(values) -> Column:
    v = F.col(values) if isinstance(values, str) else values
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(indices, values) -> Column:
    """Unit length; an empty vector where the norm is tiny."""
    n = norm(values)
    pairs = F.when(n < TINY, F.filter(_zipped(indices, values), lambda p: F.lit(False))).otherwise(_zipped(indices, values))
    return _split(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), (p["v"] / n).alias("v"))))


def exploded(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term_id, weight) of vectors (id, indices, values)."""
    return vectors.select(id_col, F.explode(_zipped("indices", "values")).alias("p")).select(id_col, F.col("p.i").alias("term_id"), F.col("p.v").alias("weight"))


#: Entries of a block, about; cells of scores, and products of single entries, that a task holds at a time.
ENTRIES, CELLS, PRODUCTS = 1 << 17, 1 << 21, 1 << 22


def _blocks(entries: DataFrame) -> DataFrame:
    """(ids, terms, row, term, weight): entries (id, term_id, weight) in blocks by a hash of the id; an entry is its id's and its term's
    number in the sorted lists, and its weight. Entries of equal id and term stay apart."""
    id_col, count = entries.columns[0], max(1, -(-entries.count() // ENTRIES))
    kinds = [entries.schema[c].dataType.simpleString() for c in (id_col, "term_id")]

    def numbered(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
        code = values.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(code.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), "<i8")
        place[order] = np.arange(len(order))
        return code.dictionary.take(pa.array(order)), place[code.indices.to_numpy()].astype("<i4")

    def run(table: pa.Table) -> pa.Table:
        (ids, row), (terms, term) = numbered(table.column(id_col)), numbered(table.column("term_id"))
        order = np.argsort(term, kind="stable")
        weight = table.column("weight").to_numpy().astype("<f8")
        cells = [pa.array([v[order].tobytes()], pa.binary()) for v in (row, term, weight)]
        return pa.table([pa.array([ids], pa.list_(ids.type)), pa.array([terms], pa.list_(terms.type)), *cells], names=["ids", "terms", "row", "term", "weight"])

    dealt = entries.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(count)))
    return materialize(dealt.groupBy("block").applyInArrow(run, f"ids array<{kinds[0]}>, terms array<{kinds[1]}>, row binary, term binary, weight binary"), "sparse")


def products(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], shape: tuple[int, int]) -> np.ndarray:
    """Dot products of sparse rows: ``one`` and ``two`` are (row, term, weight) with the same numbers of terms, ``two`` sorted by term.
    Terms that many rows of ``two`` have go by matrix products, others entry by entry, so a NaN touches rows with its term only."""
    out = np.zeros(shape)
    r, t, w = one
    r2, t2, w2 = two
    n = int(max(t.max(initial=-1), t2.max(initial=-1))) + 1
    begin, end = (np.searchsorted(t2, np.arange(n), side=side) for side in ("left", "right"))
    often = (end - begin) * 16 >= shape[1]
    often[t[~np.isfinite(w)]] = often[t2[~np.isfinite(w2)]] = False
    common = np.unique(t[often[t]])
    for i in range(0, len(common), 64):
        some = common[i : i + 64]
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        a, b = place[t] >= 0, place[t2] >= 0
        x, y = np.zeros((shape[0], len(some))), np.zeros((len(some), shape[1]))
        np.add.at(x, (r[a], place[t[a]]), w[a])
        np.add.at(y, (place[t2[b]], r2[b]), w2[b])
        out += x @ y
    rare = np.nonzero(~often[t])[0]
    times = (end - begin)[t[rare]]
    for part in np.split(rare, np.nonzero(np.diff(np.cumsum(times) // PRODUCTS))[0] + 1):
        times = (end - begin)[t[part]]
        if times.sum():
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[t[part]], times)
            cell = np.repeat(r[part].astype(np.int64), times) * shape[1] + r2[at]
            out += np.bincount(cell, np.repeat(w[part], times) * w2[at], out.size).reshape(shape)
    return out


def retrieve(weights: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score, rank: positive sparse dot products of (doc_id, term_id, weight) and (query_id, term_id, weight).

    Entries with a query's term come in blocks of documents, which meet blocks of queries; a pair of blocks returns k rows a query.
    """
    if k is None or k < 1:
        asked = queries.select("query_id", "term_id", F.col("weight").alias("asked"))
        scores = weights.join(asked, "term_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight").cast("double") * F.col("asked").cast("double")).alias("score"))
        return ranked(scores.filter("score > 0 AND NOT isnan(score)"), k)
    kind = weights.select("term_id").union(queries.select("term_id")).schema[0].dataType
    w, q = (df.select(c, F.col("term_id").cast(kind).alias("term_id"), F.col("weight").cast("double").alias("weight")).filter("term_id IS NOT NULL AND weight IS NOT NULL") for df, c in ((weights, "doc_id"), (queries, "query_id")))
    q = materialize(q, "sparse")
    w = materialize(w.join(q.select("term_id").distinct(), "term_id", "left_semi").select("doc_id", "term_id", "weight"), "sparse")
    asked = _blocks(q)
    pairs = spread(_blocks(w)).crossJoin(asked.toDF(*[f"q_{c}" for c in asked.columns]))  # a stated query set against all rows, in blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, qids = at["ids"].values, at["q_ids"].values
                (row, term, weight), (qrow, qterm, qweight) = ([np.frombuffer(at[p + c].as_py(), f) for c, f in (("row", "<i4"), ("term", "<i4"), ("weight", "<f8"))] for p in ("", "q_"))
                place = pc.fill_null(pc.index_in(at["q_terms"].values, value_set=at["terms"].values), -1).to_numpy(zero_copy_only=False)[qterm]
                order = np.argsort(qrow, kind="stable")
                order = order[place[order] >= 0]
                qrow, place, qweight = qrow[order], place[order], qweight[order]
                step = max(1, CELLS // len(ids))
                for j in range(0, len(qids), step):
                    a, b = np.searchsorted(qrow, [j, j + step])
                    s = products((qrow[a:b] - j, place[a:b], qweight[a:b]), (row, term, weight), (min(step, len(qids) - j), len(ids)))
                    s[~(s > 0)] = -np.inf
                    mine, top, score = best_of(s, k)
                    good = score > 0
                    yield pa.record_batch([qids.slice(j, step).take(pa.array(mine[good])), ids.take(pa.array(top[good])), pa.array(score[good])], names=["query_id", "doc_id", "score"])

    forms = [df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (w, "doc_id"))]
    return ranked(pairs.mapInArrow(run, f"query_id {forms[0]}, doc_id {forms[1]}, score double"), k)


def score(entries: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every query and every one of ``docs`` (doc_id), stated sets both; 0 without a common term."""
    wanted = docs.select("doc_id").distinct()
    asked = queries.select("query_id", "term_id", F.col("weight").alias("w"))
    parts = entries.join(wanted, "doc_id", "left_semi").join(asked, "term_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    every = queries.select("query_id").distinct().crossJoin(wanted)
    return every.join(parts, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))
