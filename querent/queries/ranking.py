"""Fusion, reranking, evaluation and generative queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions.text import chunks
from querent.operators import dense, evaluation, fusion, generative, rerank
from querent.operators.lexical import LexicalIndex, Smoothing, TfIdfParams, query_terms
from querent.queries.lexical import ASKED, _base, _bm25_sql
from querent.queries.vectors import _DOT, EACH, _queries, _vectors
from querent.runtime import materialize, table

DEPTH = 50


def _lists(spark, d):
    index, asked = LexicalIndex.from_texts(table(spark, d, "documents")), query_terms(spark, ASKED)
    made = {"bm25": index.bm25(asked, DEPTH), "tfidf": index.tfidf(asked, DEPTH, TfIdfParams(tf="linear", idf="smoothed")), "likelihood": index.query_likelihood(asked, DEPTH, Smoothing.dirichlet())}
    return {n: materialize(df, "list") for n, df in made.items()}


def _ranked(df, *more):
    return df.select("query_id", "doc_id", "score", *more, F.col("rank").cast("long").alias("rank"))


def _fused(method):
    return lambda spark, d: _ranked(method(_lists(spark, d)))


def three_way(spark, d):
    """The lists of three retrievers, one below the other."""
    return fusion.stacked(_lists(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def reranked(spark, d):
    """The 50 nearest by dot product with the first 32 components, reranked by cosine."""
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    first = dense.search_blocks(half(_vectors(spark, d)), half(_queries(spark, d)), DEPTH, unit=False)
    return _ranked(rerank.rerank_cosine(first, _vectors(spark, d), _queries(spark, d), 10), "original_score")


def _tokens(df):
    """Eight token vectors of eight components from each embedding."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return df.withColumn("tokens", cut)


def maxsim(spark, d):
    return _ranked(rerank.rank_maxsim(_tokens(_queries(spark, d)), _tokens(_vectors(spark, d)), k=10))


def _neighbours(spark, d):
    """Each vector with the next one by id."""
    a = _tokens(_vectors(spark, d)).select("doc_id", F.col("tokens").alias("q"))
    b = _tokens(_vectors(spark, d)).select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("t"))
    return a.join(b, "doc_id")


def aligned(spark, d):
    rows = _neighbours(spark, d).select("doc_id", F.explode(rerank.alignments("q", "t")).alias("a"))
    return rows.select("doc_id", F.col("a.q").cast("long").alias("q"), F.col("a.d").cast("long").alias("t"), F.round("a.score", 6).alias("score"))


def highlighted(spark, d):
    places = rerank.highlight("q", "t", 0.1)
    return _neighbours(spark, d).select("doc_id", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


def pooled(spark, d):
    rows = _tokens(_vectors(spark, d)).select("doc_id", rerank.pool_tokens("tokens", 3).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("at", "v")).select("doc_id", F.col("at").cast("long").alias("token"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"))


def _qrels(spark, d):
    """Every labelled document is judged for every query: quality, and one more if its id leaves the query's number by 6."""
    each = F.explode(F.array(*[F.lit(i).cast("long") for i in ASKED])).alias("query_id")
    rows = table(spark, d, "labels").select(each, "doc_id", "quality")
    return rows.select("query_id", "doc_id", (F.col("quality") + (F.col("doc_id") % 6 + 1 == F.col("query_id")).cast("int")).alias("rel"))


def _run(spark, d):
    return materialize(LexicalIndex.from_texts(table(spark, d, "documents")).bm25(query_terms(spark, ASKED), DEPTH), "run")


def metrics(spark, d):
    out = evaluation.binary_metrics(_run(spark, d), _qrels(spark, d), 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "average_precision", "reciprocal_rank")])


def graded(spark, d):
    return evaluation.graded_metrics(_run(spark, d), _qrels(spark, d), 10, 2).select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("err", 6).alias("err"))


def half_recall(spark, d):
    """Recall of neighbours found with half the components."""
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    truth = dense.search_blocks(_vectors(spark, d), _queries(spark, d), 10)
    return evaluation.neighbour_recall(truth, dense.search_blocks(half(_vectors(spark, d)), half(_queries(spark, d)), 10), 10)


def recalls(spark, d):
    return half_recall(spark, d).select("query_id", F.round("recall", 6).alias("recall"))


def robust(spark, d):
    return evaluation.robustness(half_recall(spark, d)).select("delta", F.round("share", 6).alias("share"))


def statistics(spark, d):
    """Text lengths by source."""
    out = evaluation.statistics(table(spark, d, "documents"), "n_chars", "source")
    return out.select("source", F.col("n").cast("long").alias("n"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "p50", "p95", "p99")])


def _texts(spark):
    return spark.createDataFrame([(1, "the license version"), (2, "an of"), (3, "Apache License")], "query_id long, text string")


def generated(spark, d):
    """Passages that hold a query's words, by a model whose identifiers are the words themselves."""

    class Words:
        def generate(self, queries, beam):
            return queries.select("query_id", F.posexplode(F.split("text", " ")).alias("i", "identifier")).select("query_id", "identifier", (10.0 - 0.5 * F.col("i")).alias("weight"))

    return _ranked(generative.retrieve(table(spark, d, "documents"), _texts(spark), Words(), 10))


def made(spark, d):
    """The stand-in model's identifiers for every benchmark item."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return generative.WordModel().generate(asked, 5)


def identifiers(spark, d):
    return generative.passage_identifiers(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "title", "pseudo_query")


def losses(spark, d):
    rows = _run(spark, d).join(_qrels(spark, d).withColumn("relevant", F.col("rel") > 1), ["query_id", "doc_id"]).select("query_id", "doc_id", "score", "relevant")
    return generative.rank_losses(rows, generative.LtrConfig(margin=5.0)).select("query_id", F.round("loss1", 6).alias("loss1"))


def chunked(spark, d):
    """Lines of documents as chunks, with composite keys."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(chunks("text", "\\n")).alias("c"))
    return rows.select("doc_id", F.col("c.chunk").cast("long").alias("chunk"), F.char_length("c.text").cast("long").alias("n_chars"))


def context(spark, d):
    """The five best documents of each query as one numbered context; its length and ids."""
    best = _run(spark, d).filter("rank <= 5").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("t"))))
    rows = best.groupBy("query_id").agg(parts.alias("p"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: x["doc_id"].cast("string")), ",").alias("ids"), F.char_length(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).cast("long").alias("n_chars"))


_TOPS = f"""{_base()},
b AS (SELECT query_id, doc_id, round(sum({_bm25_sql()}), 12) AS score FROM m GROUP BY query_id, doc_id HAVING sum({_bm25_sql()}) > 0),
t AS (SELECT query_id, doc_id, round(sum(qtf * tf * ln(1 + (n - df + 0.5) / (df + 0.5))), 12) AS score FROM m GROUP BY query_id, doc_id),
prs AS (SELECT DISTINCT query_id, doc_id, dl, total FROM m),
trm AS (SELECT q.query_id, q.term, q.qtf, df.cf FROM q JOIN df ON q.term = df.term),
l AS (SELECT p.query_id, p.doc_id, round(sum(t.qtf * ln((coalesce(tf.tf, 0) + 1000.0 * t.cf / p.total) / (p.dl + 1000.0))), 12) AS score
      FROM prs p JOIN trm t ON p.query_id = t.query_id LEFT JOIN tf ON tf.term = t.term AND tf.doc_id = p.doc_id GROUP BY p.query_id, p.doc_id),
a AS (SELECT 'bm25' AS method, * FROM b UNION ALL SELECT 'tfidf', * FROM t UNION ALL SELECT 'likelihood', * FROM l),
k AS (SELECT * FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= {DEPTH}),
z AS (SELECT *, count(*) OVER w AS nn, min(score) OVER w AS low, max(score) OVER w AS high, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM k WINDOW w AS (PARTITION BY method, query_id)),
y AS (SELECT *, CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END AS scaled,
      CASE WHEN sd > 0 THEN greatest(0.0, least(1.0, (score - (mu - 3 * sd)) / (6 * sd))) ELSE 0.5 END AS cut FROM z)"""


def _fusion_sql(e):
    return f"{_TOPS}, s AS (SELECT query_id, doc_id, round({e}, 12) AS score FROM y GROUP BY query_id, doc_id) SELECT query_id, doc_id, score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


_CUT = "[list_transform({e}[8 * i + 1 : 8 * i + 8], lambda v: v::DOUBLE) for i in range(8)]"
_TOK = f"WITH u AS (SELECT vec_id, {_CUT.format(e='embedding')} AS t FROM embeddings)"
_TT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_LIST = f"(SELECT query_id, doc_id, rank FROM k WHERE method = 'bm25')"
_JUDGED = f"""{_TOPS},
qr AS (SELECT query_id::BIGINT AS query_id, doc_id, quality + (CASE WHEN doc_id % 6 + 1 = query_id THEN 1 ELSE 0 END) AS rel FROM labels, (VALUES (1), (2), (3), (4), (5), (6)) v(query_id)),
jr AS (SELECT r.query_id, r.doc_id, r.rank, coalesce(q.rel, 0) AS rel FROM {_LIST} r LEFT JOIN qr q USING (query_id, doc_id)),
jh AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM jr),
nr AS (SELECT query_id, count(*) FILTER (WHERE rel > 0) AS relevant FROM qr GROUP BY query_id)"""
_HALF = "embedding[1:32]"
_UNITS = "WITH u AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS e, list_transform(embedding[1:32], lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding[1:32], lambda w: w::DOUBLE * w::DOUBLE)))) AS h FROM embeddings)"
_RECALL = f"""{_UNITS},
s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round({_DOT.format(a='q.e', b='x.e')}, 12) AS f, round({_DOT.format(a='q.h', b='x.h')}, 12) AS g FROM u q, u x WHERE q.vec_id % {EACH} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, doc_id) AS b FROM s),
c AS (SELECT query_id, round(count(*) FILTER (WHERE a <= 10 AND b <= 10)::DOUBLE / count(*) FILTER (WHERE a <= 10), 6) AS recall FROM r GROUP BY query_id)"""

QUERIES = {
    "three_way_lists": three_way,
    "fusion_rrf": _fused(fusion.rrf),
    "fusion_isr": _fused(fusion.isr),
    "fusion_borda": _fused(fusion.borda),
    "fusion_combsum": _fused(fusion.combsum),
    "fusion_combmnz": _fused(fusion.combmnz),
    "fusion_dbsf": _fused(fusion.dbsf),
    "fusion_weighted": _fused(lambda lists: fusion.weighted(lists, {"bm25": 0.5, "tfidf": 0.3, "likelihood": 0.2})),
    "rerank_cosine": reranked,
    "rerank_maxsim": maxsim,
    "rerank_alignments": aligned,
    "rerank_highlight": highlighted,
    "rerank_pool_tokens": pooled,
    "evaluation_binary": metrics,
    "evaluation_graded": graded,
    "evaluation_neighbour_recall": recalls,
    "evaluation_robustness": robust,
    "evaluation_statistics": statistics,
    "generative_retrieval": generated,
    "generative_identifiers": made,
    "passage_identifiers": identifiers,
    "rank_losses": losses,
    "chunking": chunked,
    "context_assembly": context,
}

SQL = {
    "three_way_lists": f"{_TOPS} SELECT method, query_id, doc_id, score, rank FROM k",
    "fusion_rrf": _fusion_sql("sum(1 / (60.0::DOUBLE + rank))"),
    "fusion_isr": _fusion_sql("count(*) * sum(1.0::DOUBLE / (rank * rank))"),
    "fusion_borda": _fusion_sql("sum((nn - rank)::DOUBLE)"),
    "fusion_combsum": _fusion_sql("sum(scaled)"),
    "fusion_combmnz": _fusion_sql("sum(scaled) * count(*)"),
    "fusion_dbsf": _fusion_sql("sum(cut)"),
    "fusion_weighted": _fusion_sql("sum(CASE method WHEN 'bm25' THEN 0.5::DOUBLE WHEN 'tfidf' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * scaled)"),
    "rerank_cosine": f"""
WITH h AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round({_DOT.format(a='q.embedding[1:32]', b='x.embedding[1:32]')}, 12) AS original_score, q.embedding AS qe, x.embedding AS xe FROM embeddings q, embeddings x WHERE q.vec_id % {EACH} = 0),
f AS (SELECT * FROM (SELECT * REPLACE (round(original_score, 6) AS original_score), row_number() OVER (PARTITION BY query_id ORDER BY original_score DESC, doc_id) AS r0 FROM h) WHERE r0 <= {DEPTH}),
s AS (SELECT query_id, doc_id, original_score, round({_DOT.format(a='qe', b='xe')} / (sqrt({_DOT.format(a='qe', b='qe')}) * sqrt({_DOT.format(a='xe', b='xe')})), 12) AS score FROM f)
SELECT query_id, doc_id, score, original_score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "rerank_maxsim": f"""{_TOK},
s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_sum([list_max([{_TT.format(a='a', b='b')} for b in x.t]) for a in q.t]), 12) AS score FROM u q, u x WHERE q.vec_id % {EACH} = 0)
SELECT query_id, doc_id, score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "rerank_alignments": f"""{_TOK},
e AS (SELECT vec_id, unnest(range(8)) AS i, unnest(t) AS v FROM u),
s AS (SELECT a.vec_id AS doc_id, a.i AS q, b.i AS t, {_TT.format(a='a.v', b='b.v')} AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT doc_id, q, t, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, q ORDER BY score DESC, t) AS pos FROM s) WHERE pos = 1""",
    "rerank_highlight": f"""{_TOK},
e AS (SELECT vec_id, unnest(range(8)) AS i, unnest(t) AS v FROM u),
s AS (SELECT a.vec_id AS doc_id, b.i AS t, max({_TT.format(a='a.v', b='b.v')}) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 GROUP BY a.vec_id, b.i)
SELECT doc_id, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (WHERE score >= 0.1), '') AS places FROM s GROUP BY doc_id""",
    "rerank_pool_tokens": """
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT vec_id, i // 24 AS token, i % 8 AS c, avg(v) AS v FROM e GROUP BY ALL)
SELECT vec_id AS doc_id, token::BIGINT AS token, round(sum(v), 6) + 0.0 AS total FROM g GROUP BY vec_id, token""",
    "evaluation_binary": f"""{_JUDGED}
SELECT n.query_id, round(coalesce(sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 ELSE 0 END), 0) / 10.0::DOUBLE, 6) AS precision,
       round(coalesce(sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 ELSE 0 END)::DOUBLE / any_value(relevant), 0), 6) AS recall,
       round(coalesce(sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(10, any_value(relevant)) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 0), 6) AS ndcg,
       round(coalesce(sum(CASE WHEN rel > 0 THEN hits::DOUBLE / rank ELSE 0 END) / any_value(relevant), 0), 6) AS average_precision,
       round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel > 0), 0), 6) AS reciprocal_rank
FROM nr n LEFT JOIN jh ON n.query_id = jh.query_id GROUP BY n.query_id""",
    "evaluation_graded": f"""{_JUDGED},
id AS (SELECT query_id, sum((2.0::DOUBLE ** rel - 1) / log2(pos + 1.0::DOUBLE)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS pos FROM qr) WHERE pos <= 10 GROUP BY query_id),
st2 AS (SELECT *, (2.0::DOUBLE ** rel - 1) / 4 AS stop FROM jr WHERE rank <= 10),
pr AS (SELECT *, coalesce(exp(sum(ln(1 - stop)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS go FROM st2)
SELECT i.query_id, round(coalesce(sum((2.0::DOUBLE ** rel - 1) / log2(rank + 1.0::DOUBLE)) / any_value(ideal), 0), 6) AS ndcg, round(coalesce(sum(stop * go / rank), 0), 6) AS err
FROM id i LEFT JOIN pr USING (query_id) GROUP BY i.query_id""",
    "evaluation_neighbour_recall": f"{_RECALL} SELECT query_id, recall FROM c",
    "evaluation_robustness": f"{_RECALL} SELECT delta::DOUBLE AS delta, round(avg(CASE WHEN recall >= delta THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM c, (VALUES (0.5), (0.7), (0.8), (0.9), (0.95), (0.99)) v(delta) GROUP BY delta",
    "evaluation_statistics": """
WITH r AS (SELECT source, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, any_value(n)::BIGINT AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max,
       min(v) FILTER (WHERE i = floor(0.5 * (n - 1) + 0.5)) AS p50, min(v) FILTER (WHERE i = floor(0.95::DOUBLE * (n - 1) + 0.5)) AS p95, min(v) FILTER (WHERE i = floor(0.99::DOUBLE * (n - 1) + 0.5)) AS p99 FROM r GROUP BY source""",
    "generative_retrieval": """
WITH i AS (SELECT * FROM (VALUES (1::BIGINT, 'the', 10.0::DOUBLE), (1, 'license', 9.5), (1, 'version', 9.0), (3, 'apache', 10.0), (3, 'license', 9.5)) v(query_id, term, weight)),
e AS (SELECT unnest([1, 2, 3])::BIGINT AS query_id),
s AS (SELECT e.query_id, d.doc_id, round(coalesce(sum(CASE WHEN contains(lower(coalesce(d.text, '')), i.term) THEN weight ELSE 0 END), 0), 12) AS score FROM documents d CROSS JOIN e LEFT JOIN i ON i.query_id = e.query_id GROUP BY e.query_id, d.doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "generative_identifiers": r"""
WITH w AS (SELECT item_id AS query_id, list_filter(string_split_regex(text, '\s+'), lambda x: strlen(x) > 2)[1:5] AS ws FROM benchmark),
e AS (SELECT query_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w)
SELECT query_id, 'title' AS view, upper(replace(word, 'ß', 'ss')) || ' Topic' AS identifier, 10.0::DOUBLE - 0.5 * i AS weight FROM e
UNION ALL SELECT query_id, 'substring', word || ' is a key concept', 10.0 - 0.5 * i FROM e
UNION ALL SELECT query_id, 'pseudo_query', 'what is ' || word, 10.0 - 0.5 * i FROM e
UNION ALL SELECT query_id, v, v || ' result', 5.0 FROM w, (VALUES ('title'), ('substring'), ('pseudo_query')) t(v) WHERE len(ws) = 0""",
    "passage_identifiers": """
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, trim(split_part(coalesce(text, ''), chr(10), 1)) AS line, trim(split_part(coalesce(text, ''), '.', 1)) AS sentence FROM documents),
w AS (SELECT doc_id, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) AS word FROM l),
c AS (SELECT doc_id, word, count(*) AS c FROM w WHERE strlen(word) > 3 GROUP BY doc_id, word),
b AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS pseudo_query FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, word) AS pos FROM c) WHERE pos <= 5 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(line) < 200 AND line <> '' THEN line WHEN length(sentence) < 200 AND sentence <> '' THEN sentence ELSE trim(t[1:50]) END AS title, coalesce(pseudo_query, '') AS pseudo_query FROM l LEFT JOIN b USING (doc_id)""",
    "rank_losses": f"""{_JUDGED},
jl AS (SELECT r.query_id, k.score, q.rel > 1 AS relevant FROM {_LIST} r JOIN k ON k.method = 'bm25' AND k.query_id = r.query_id AND k.doc_id = r.doc_id JOIN qr q ON q.query_id = r.query_id AND q.doc_id = r.doc_id)
SELECT query_id, round(coalesce(greatest(0.0, 5.0 + max(score) FILTER (WHERE NOT relevant) - max(score) FILTER (WHERE relevant)), 0.0), 6) AS loss1 FROM jl GROUP BY query_id""",
    "chunking": """
WITH p AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS c FROM documents)
SELECT doc_id, unnest(range(len(c)))::BIGINT AS chunk, length(unnest(c))::BIGINT AS n_chars FROM p""",
    "context_assembly": f"""{_TOPS}
SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids, (sum(length(coalesce(text, '')) + 4) + count(*) - 1)::BIGINT AS n_chars
FROM {_LIST} r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""",
}
