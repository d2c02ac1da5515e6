"""Dense and sparse queries over embeddings, and metadata filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import vectors as V
from querent.operators import dense, filters, sparse
from querent.runtime import table

#: Every row whose id is divisible by this is a query against all rows.
EACH = 20


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _queries(spark, d):
    return table(spark, d, "embeddings").filter(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _long(df, *columns):
    return df.select(*columns, F.col("rank").cast("long").alias("rank"))


def knn(spark, d):
    return _long(dense.search_blocks(_vectors(spark, d), _queries(spark, d), 10), "query_id", "doc_id", "score")


def truth(spark, d):
    return _long(dense.ground_truth(_vectors(spark, d), _queries(spark, d), 10), "query_id", "doc_id", "distance")


def dot_search(spark, d):
    """Column expressions against three fixed queries."""
    asked = {i: [((i + 1) * (j + 3) % 11 - 5) / 10 for j in range(64)] for i in range(3)}
    return _long(dense.retrieve(_vectors(spark, d), asked, 10), "query_id", "doc_id", "score")


def filtered(spark, d):
    where = filters.any_of(filters.equals("label", 3), filters.equals("label", 5))
    rows = _vectors(spark, d).filter(where)
    return _long(dense.search_blocks(rows, _queries(spark, d), 5), "query_id", "doc_id", "score")


def by_category(spark, d):
    """Neighbours within the query's own label."""
    rows, asked = _vectors(spark, d), table(spark, d, "embeddings").filter(F.col("vec_id") % EACH == 0)
    parts = None
    for label in sorted(r["label"] for r in rows.select("label").distinct().collect()):  # one value a category
        one = dense.search_blocks(rows.filter(F.col("label") == label), asked.filter(F.col("label") == label).select(F.col("vec_id").alias("query_id"), "embedding"), 5)
        parts = one if parts is None else parts.unionByName(one)
    return _long(parts, "query_id", "doc_id", "score")


def scalars(spark, d):
    """All scalar functions of each vector and the one it precedes by sorting, by id."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    rows = a.join(b, "vec_id")
    made = {"dot": V.dot("a", "b"), "norm": V.norm("a"), "cosine": V.cosine("a", "b"), "cosine_distance": V.cosine_distance("a", "b"), "l2": V.l2("a", "b"), "l2_squared": V.l2_squared("a", "b"), "inner_product_distance": V.inner_product_distance("a", "b")}
    return rows.select("vec_id", *[(F.round(v, 6) + 0.0).alias(n) for n, v in made.items()])


def cache(spark, d):
    """All vectors are cached answers, of which each query finds its own or an earlier equal one; a hit from cosine 0.5 on."""
    stored = _vectors(spark, d).withColumn("response", F.concat(F.lit("answer "), F.col("doc_id").cast("string")))
    return dense.cached_answers(stored, _queries(spark, d), 0.5)


def augmented(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", filters.augment("embedding", F.col("label"), 16, 2.0).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(V.norm("x"), 6).alias("norm"), (F.array_position("x", 2.0) - 64 - 1).alias("category"), F.round(V.norm(filters.original("x", 64)), 6).alias("original_norm"))


def facets(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return filters.facet_counts(docs, "source", filters.all_of(filters.equals("quality", 1), filters.equals("lang", "en")))


def facets_all(spark, d):
    return filters.facet_counts(table(spark, d, "documents"), "lang")


def distinct_values(spark, d):
    return filters.values_of(table(spark, d, "documents"), "source")


def selectivity(spark, d):
    docs = table(spark, d, "documents")
    return filters.selectivity(docs, filters.any_of(filters.equals("lang", "de"), filters.all_of(filters.equals("lang", "en"), filters.equals("source", "src0")))).select(F.round("selectivity", 6).alias("selectivity"))


def _sparse(spark, d):
    """Components above 0.1 in absolute value, of every vector."""
    pairs = F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda p: F.abs(p["v"]) > 0.1)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values"))


def sparse_search(spark, d):
    rows = sparse.exploded(_sparse(spark, d))
    asked = rows.filter(F.col("doc_id") % EACH == 0).withColumnRenamed("doc_id", "query_id")
    return _long(sparse.retrieve(rows, asked, 10), "query_id", "doc_id", "score")


def sparse_vectors(spark, d):
    """Validity, pruning, top entries and norms of sparse vectors."""
    i, v = "indices", "values"
    rows = _sparse(spark, d).select("doc_id", sparse.is_valid(i, v).alias("valid"), F.size(v).cast("long").alias("nnz"), sparse.prune(i, v, 0.2).alias("p"), sparse.top(i, v, 3).alias("t"), sparse.norm(v).alias("norm"), sparse.normalize(i, v).alias("u"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", "valid", "nnz", listed("p.indices").alias("pruned"), listed("t.indices").alias("top"), F.round("norm", 6).alias("norm"), F.round(sparse.norm("u.values"), 6).alias("unit"))


def sparse_terms(spark, d):
    """Sparse retrieval over term weights 1 + ln tf of documents."""
    from querent.operators.lexical import LexicalIndex
    from querent.queries.lexical import ASKED

    rows = LexicalIndex.from_texts(table(spark, d, "documents")).postings.select("doc_id", F.col("term").alias("term_id"), (1 + F.log("tf")).alias("weight"))
    asked = spark.createDataFrame([(i, t, 1.0 / (n + 1)) for i, q in ASKED.items() for n, t in enumerate(dict.fromkeys(q.split()))], "query_id long, term_id string, weight double")
    return _long(sparse.retrieve(rows, asked, 10), "query_id", "doc_id", "score")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_UNIT = "WITH u AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS e FROM embeddings)"
_COS = _DOT.format(a="q.e", b="x.e")
_LAST = "SELECT query_id, doc_id, score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"


def _knn_sql(where="TRUE", k=10):
    return f"{_UNIT}, s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round({_COS}, 12) AS score FROM u q, u x WHERE q.vec_id % 20 = 0 AND {where}) {_LAST} WHERE rank <= {k}"


_SP = "WITH e AS (SELECT vec_id AS doc_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT * FROM e WHERE abs(v) > 0.1)"
_ASKED_DOT = " UNION ALL ".join("SELECT {i}::BIGINT AS query_id, [{v}] AS q".format(i=i, v=", ".join(str(((i + 1) * (j + 3) % 11 - 5) / 10) + "::DOUBLE" for j in range(64))) for i in range(3))

QUERIES = {
    "dense_knn": knn,
    "dense_ground_truth": truth,
    "dense_dot_product": dot_search,
    "dense_filtered": filtered,
    "dense_by_category": by_category,
    "vector_scalars": scalars,
    "semantic_cache": cache,
    "filter_fusion": augmented,
    "facet_counts": facets_all,
    "facet_counts_filtered": facets,
    "facet_values": distinct_values,
    "filter_selectivity": selectivity,
    "sparse_search": sparse_search,
    "sparse_vectors": sparse_vectors,
    "sparse_terms": sparse_terms,
}

SQL = {
    "dense_knn": _knn_sql(),
    "dense_ground_truth": f"SELECT query_id, doc_id, round(1 - score, 6) AS distance, rank FROM ({_knn_sql()})",
    "dense_dot_product": f"WITH a AS ({_ASKED_DOT}), s AS (SELECT query_id, vec_id AS doc_id, round({_DOT.format(a='embedding', b='q')}, 12) AS score FROM embeddings, a), t AS (SELECT * FROM s WHERE score > 0) {_LAST.replace('FROM s', 'FROM t')} WHERE rank <= 10",
    "dense_filtered": _knn_sql("x.label IN (3, 5)", 5),
    "dense_by_category": _knn_sql("x.label = q.label", 5),
    "vector_scalars": f"""
WITH r AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {_DOT.format(a='a', b='b')} AS d, sqrt({_DOT.format(a='a', b='a')}) AS na, sqrt({_DOT.format(a='b', b='b')}) AS nb,
      list_sum(list_transform(list_zip(a, b), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS g FROM r)
SELECT vec_id, round(d, 6) + 0.0 AS dot, round(na, 6) + 0.0 AS norm, round(d / (na * nb), 6) + 0.0 AS cosine, round(1 - d, 6) + 0.0 AS cosine_distance,
       round(sqrt(g), 6) + 0.0 AS l2, round(g, 6) + 0.0 AS l2_squared, round(-d, 6) + 0.0 AS inner_product_distance FROM s""",
    "semantic_cache": f"""{_UNIT}, s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round({_COS}, 12) AS score FROM u q, u x WHERE q.vec_id % 20 = 0),
b AS ({_LAST} WHERE rank = 1)
SELECT query_id, score >= 0.5 AS hit, CASE WHEN score >= 0.5 THEN 'answer ' || doc_id END AS response, score FROM b""",
    "filter_fusion": f"SELECT vec_id, 80::BIGINT AS n, round(sqrt({_DOT.format(a='embedding', b='embedding')} + 4.0), 6) AS norm, label::BIGINT AS category, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) AS original_norm FROM embeddings",
    "facet_counts": "SELECT lang AS value, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "facet_counts_filtered": "SELECT source AS value, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en' AND source IS NOT NULL GROUP BY source",
    "facet_values": "SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL",
    "filter_selectivity": "SELECT round(avg(CASE WHEN coalesce(lang = 'de', FALSE) OR (coalesce(lang = 'en', FALSE) AND coalesce(source = 'src0', FALSE)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS selectivity FROM documents",
    "sparse_search": f"{_SP}, s AS (SELECT q.doc_id AS query_id, x.doc_id, round(sum(q.v * x.v), 12) AS score FROM p q JOIN p x USING (i) WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, x.doc_id HAVING sum(q.v * x.v) > 0) {_LAST} WHERE rank <= 10",
    "sparse_vectors": f"""{_SP},
t AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v) DESC, i) AS place FROM p) WHERE place <= 3),
g AS (SELECT doc_id, count(*)::BIGINT AS nnz, sqrt(sum(v * v)) AS norm, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (WHERE abs(v) >= 0.2), '') AS pruned FROM p GROUP BY doc_id),
h AS (SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS top FROM t GROUP BY doc_id)
SELECT e.vec_id AS doc_id, TRUE AS valid, coalesce(nnz, 0) AS nnz, coalesce(pruned, '') AS pruned, coalesce(top, '') AS top, round(coalesce(norm, 0), 6) AS norm, CASE WHEN norm IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS unit
FROM embeddings e LEFT JOIN g ON e.vec_id = g.doc_id LEFT JOIN h ON e.vec_id = h.doc_id""",
}


def _sparse_terms_sql():
    from querent.queries.lexical import ASKED, _base

    values = ", ".join(f"({i}, '{t}', {1.0 / (n + 1)!r}::DOUBLE)" for i, q in ASKED.items() for n, t in enumerate(dict.fromkeys(q.split())))
    return f"{_base()}, a AS (SELECT query_id::BIGINT AS query_id, term, w FROM (VALUES {values}) v(query_id, term, w)), s AS (SELECT query_id, doc_id, round(sum(w * (1 + ln(tf.tf))), 12) AS score FROM a JOIN tf ON a.term = tf.term GROUP BY query_id, doc_id) {_LAST} WHERE rank <= 10"


SQL["sparse_terms"] = _sparse_terms_sql()
