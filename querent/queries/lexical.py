"""Lexical queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.operators import expansion, routing
from querent.operators.lexical import Bm25Params, LexicalIndex, Smoothing, TfIdfParams, query_terms
from querent.runtime import table

#: The stated queries; the corpus is invented prose, so its frequent and rarer words serve.
ASKED = {1: "the and of that", 2: "les des une", 3: "der die und", 4: "que los las", 5: "license version apache", 6: "the the with from"}
SINGLE = {1: "the and of that"}
UNSEEN = {7: "zzzz qqqq"}


def _index(spark, sf_dir):
    return LexicalIndex.from_texts(table(spark, sf_dir, "documents"))


def _asked(spark, queries=None):
    return query_terms(spark, queries or ASKED)


def _ranked(df):
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _bm25(params):
    return lambda spark, d: _ranked(_index(spark, d).bm25(_asked(spark), 10, params))


def _tfidf(params):
    return lambda spark, d: _ranked(_index(spark, d).tfidf(_asked(spark), 10, params))


def _likelihood(smoothing, queries=None):
    return lambda spark, d: _ranked(_index(spark, d).query_likelihood(_asked(spark, queries), 10, smoothing))


def topk(spark, d):
    """The flagship: one query, top 10."""
    return _ranked(_index(spark, d).bm25(_asked(spark, SINGLE), 10))


def statistics(spark, d):
    index = _index(spark, d)
    n, total = index.totals
    return spark.createDataFrame([(n, total, round(index.average_length, 6))], "n long, total_terms long, avgdl double")


def idf(spark, d):
    index = _index(spark, d)
    return index.term_stats.select("term", "df", "cf", F.round(index.bm25_idf(F.col("df")), 6).alias("idf"))


def eager(spark, d):
    return _ranked(_index(spark, d).eager().retrieve(_asked(spark), 10))


def feedback(method):
    def run(spark, d):
        index, asked = _index(spark, d), _asked(spark)
        first = index.bm25(asked, 100)
        return expansion.expansion_terms(index, asked, first, expansion.Expander(method=method)).select("query_id", "term", "score", F.col("rank").cast("long").alias("rank"))

    return run


def expanded(spark, d):
    return _ranked(expansion.retrieve_with_feedback(_index(spark, d), _asked(spark), 100, 10))


def routes(spark, d):
    """Every conversation turn as a query."""
    from querent.functions.text import tokens

    rows = table(spark, d, "conversations").select("conv_id", "turn", tokens("text").alias("terms"))
    out = routing.routed(rows)
    return out.select("conv_id", "turn", F.col("n_terms").cast("long").alias("n_terms"), F.round("avg_length", 6).alias("avg_length"), F.round("complexity", 6).alias("complexity"), "kind", F.array_join("retrievers", ",").alias("retrievers"))


def vocabulary(spark, d):
    return _index(spark, d).vocabulary().withColumn("term_id", F.col("term_id").cast("long"))


def prefix(spark, d):
    """Terms that begin with "th" and their frequencies."""
    return _index(spark, d).term_stats.filter(F.col("term").startswith("th"))


def _rows(queries):
    values = ", ".join(f"({i}, '{t}')" for i, q in queries.items() for t in q.split())
    return f"(VALUES {values}) v(query_id, term)"


def _base(queries=None):
    return f"""
WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents),
dl AS (SELECT d.doc_id, count(t.term)::BIGINT AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, sum(dl)::DOUBLE AS total FROM dl),
tf AS (SELECT term, doc_id, count(*)::BIGINT AS tf FROM tok GROUP BY term, doc_id),
df AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term),
q AS (SELECT query_id::BIGINT AS query_id, term, count(*)::BIGINT AS qtf FROM {_rows(queries or ASKED)} GROUP BY query_id, term),
m AS (SELECT q.query_id, q.term, q.qtf, tf.doc_id, tf.tf, dl.dl, df.df, df.cf, st.n, st.avgdl, st.total
      FROM q JOIN tf ON q.term = tf.term JOIN df ON q.term = df.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st)"""


TOP = """,
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""


def _scored(expression, queries=None, having="HAVING sum({e}) > 0"):
    return f"{_base(queries)}, s AS (SELECT query_id, doc_id, round(sum({expression}), 12) AS score FROM m GROUP BY query_id, doc_id {having.format(e=expression)}){TOP}"


def _bm25_sql(added=0.0, queries=None, k1=1.2, b=0.75, qtf="qtf"):
    part = f"tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / avgdl))"
    return f"{qtf} * ln((n - df + 0.5) / (df + 0.5) + 1) * ({part} + {added})"


_LOG_TF, _LINEAR = "(1 + ln(tf))", "tf"
_IDF, _SMOOTH = "ln(n / df)", "ln(1 + (n - df + 0.5) / (df + 0.5))"


def _likelihood_sql(smoothed):
    return f"""{_base()},
pairs AS (SELECT DISTINCT query_id, doc_id, dl, total FROM m),
terms AS (SELECT q.query_id, q.term, q.qtf, df.cf FROM q JOIN df ON q.term = df.term),
s AS (SELECT p.query_id, p.doc_id, round(sum(t.qtf * ln({smoothed})), 12) AS score
      FROM pairs p JOIN terms t ON p.query_id = t.query_id LEFT JOIN tf ON tf.term = t.term AND tf.doc_id = p.doc_id GROUP BY p.query_id, p.doc_id){TOP}"""


def _feedback_sql(score):
    return f"""{_base()},
s AS (SELECT query_id, doc_id, round(sum({_bm25_sql()}), 12) AS score FROM m GROUP BY query_id, doc_id HAVING sum({_bm25_sql()}) > 0),
f AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5),
z AS (SELECT query_id, count(*) AS depth FROM f GROUP BY query_id),
e AS (SELECT f.query_id, tf.term, sum(tf.tf) AS tf, count(*)::DOUBLE AS r FROM f JOIN tf ON f.doc_id = tf.doc_id
      WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = f.query_id AND q.term = tf.term) GROUP BY f.query_id, tf.term),
x AS (SELECT e.query_id, e.term, round({score}, 12) AS score FROM e JOIN df ON e.term = df.term JOIN z ON e.query_id = z.query_id CROSS JOIN st),
y AS (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM x)"""


_TERMS = "\nSELECT query_id, term, score, rank FROM y WHERE rank <= 5"
_EXPANDED = f""",
q2 AS (SELECT query_id, term, sum(qtf)::BIGINT AS qtf FROM (SELECT query_id, term, qtf FROM q UNION ALL SELECT query_id, term, 1 FROM y WHERE rank <= 5) GROUP BY query_id, term),
m2 AS (SELECT q2.query_id, q2.qtf, tf.doc_id, tf.tf, dl.dl, df.df, st.n, st.avgdl FROM q2 JOIN tf ON q2.term = tf.term JOIN df ON q2.term = df.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st),
s2 AS (SELECT query_id, doc_id, round(sum({_bm25_sql()}), 12) AS score FROM m2 GROUP BY query_id, doc_id HAVING sum({_bm25_sql()}) > 0),
r2 AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s2)
SELECT query_id, doc_id, score, rank FROM r2 WHERE rank <= 10"""
_RSV = "e.r * ln(((e.r + 0.5) * (st.n - df.df - z.depth + e.r + 0.5)) / ((df.df - e.r + 0.5) * (z.depth - e.r + 0.5)))"

QUERIES = {
    "bm25_topk": topk,
    "bm25_batch": _bm25(Bm25Params()),
    "bm25_l": _bm25(Bm25Params(variant="l")),
    "bm25_plus": _bm25(Bm25Params(variant="plus")),
    "bm25_eager": eager,
    "bm25_idf": idf,
    "index_statistics": statistics,
    "index_vocabulary": vocabulary,
    "index_prefix": prefix,
    "tfidf_log_standard": _tfidf(TfIdfParams()),
    "tfidf_linear_standard": _tfidf(TfIdfParams(tf="linear")),
    "tfidf_log_smoothed": _tfidf(TfIdfParams(idf="smoothed")),
    "tfidf_linear_smoothed": _tfidf(TfIdfParams("linear", "smoothed")),
    "likelihood_dirichlet": _likelihood(Smoothing.dirichlet()),
    "likelihood_jelinek_mercer": _likelihood(Smoothing.jelinek_mercer()),
    "likelihood_fallback": _likelihood(Smoothing.dirichlet(), UNSEEN),
    "feedback_terms_idf": feedback("idf"),
    "feedback_terms_tf": feedback("tf"),
    "feedback_terms_rsv": feedback("rsv"),
    "feedback_retrieval": expanded,
    "query_routing": routes,
}

SQL = {
    "bm25_topk": _scored(_bm25_sql(), SINGLE),
    "bm25_batch": _scored(_bm25_sql()),
    "bm25_l": _scored(_bm25_sql(0.5)),
    "bm25_plus": _scored(_bm25_sql(1.0)),
    "bm25_eager": _scored(_bm25_sql(qtf="1")),
    "bm25_idf": f"{_base()} SELECT term, df, cf, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df CROSS JOIN st",
    "index_statistics": f"{_base()} SELECT n::BIGINT AS n, total::BIGINT AS total_terms, round(avgdl, 6) AS avgdl FROM st",
    "index_vocabulary": f"{_base()} SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id FROM df",
    "index_prefix": f"{_base()} SELECT term, df, cf FROM df WHERE starts_with(term, 'th')",
    "tfidf_log_standard": _scored(f"qtf * {_LOG_TF} * {_IDF}", having=""),
    "tfidf_linear_standard": _scored(f"qtf * {_LINEAR} * {_IDF}", having=""),
    "tfidf_log_smoothed": _scored(f"qtf * {_LOG_TF} * {_SMOOTH}", having=""),
    "tfidf_linear_smoothed": _scored(f"qtf * {_LINEAR} * {_SMOOTH}", having=""),
    "likelihood_dirichlet": _likelihood_sql("(coalesce(tf.tf, 0) + 1000.0 * t.cf / p.total) / (p.dl + 1000.0)"),
    "likelihood_jelinek_mercer": _likelihood_sql("0.5 * coalesce(tf.tf, 0) / p.dl + 0.5 * t.cf / p.total"),
    "likelihood_fallback": "SELECT 7::BIGINT AS query_id, doc_id, 0.0::DOUBLE AS score, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10",
    "feedback_terms_idf": _feedback_sql("ln(st.n / df.df)") + _TERMS,
    "feedback_terms_tf": _feedback_sql("e.tf::DOUBLE") + _TERMS,
    "feedback_terms_rsv": _feedback_sql(_RSV) + _TERMS,
    "feedback_retrieval": _feedback_sql("ln(st.n / df.df)") + _EXPANDED,
    "query_routing": """
WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM conversations),
f AS (SELECT *, len(terms) AS n, coalesce(list_sum(list_transform(terms, lambda x: strlen(x))), 0) AS bytes, len(list_distinct(terms)) AS kinds FROM t),
g AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE bytes::DOUBLE / n END AS avg_length, CASE WHEN n = 0 THEN 0.0 ELSE kinds::DOUBLE / n END AS complexity FROM f),
h AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN complexity > 0.8 AND avg_length > 5 THEN 'semantic' WHEN complexity < 0.5 AND avg_length < 4 THEN 'keyword' ELSE 'hybrid' END AS kind FROM g)
SELECT conv_id, turn, n::BIGINT AS n_terms, round(avg_length, 6) AS avg_length, round(complexity, 6) AS complexity, kind,
       CASE kind WHEN 'keyword' THEN 'bm25,sparse' WHEN 'semantic' THEN 'dense' ELSE 'bm25,dense' END AS retrievers FROM h""",
}
