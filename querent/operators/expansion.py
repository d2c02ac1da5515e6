"""Pseudo-relevance feedback: retrieve, take terms from the best documents, retrieve again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators.lexical import Bm25Params, LexicalIndex
from querent.operators.topk import ranked
from querent.runtime import materialize


@dataclass(frozen=True)
class Expander:
    """method: idf (ln N/df), tf (occurrences in the feedback documents) or rsv (Robertson's selection value)."""

    depth: int = 5
    terms: int = 5
    weight: float = 0.5
    method: str = "idf"

    def __post_init__(self):
        object.__setattr__(self, "weight", min(1.0, max(0.0, self.weight)))
        if self.method not in ("idf", "tf", "rsv"):
            raise InvalidParameter(f"unknown method {self.method}")


def expansion_terms(index: LexicalIndex, queries: DataFrame, first: DataFrame, expander: Expander = Expander()) -> DataFrame:
    """query_id, term, score, rank: the terms to add, from the first ``depth`` results of ``first``; the query's own are left out."""
    best = first.filter(F.col("rank") <= expander.depth).select("query_id", "doc_id")
    rows = index.docs.join(best, "doc_id").select("query_id", "doc_id", F.explode("terms").alias("term"))
    seen = rows.groupBy("query_id", "term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("r"))
    own = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    seen = materialize(seen.join(own, ["query_id", "term"], "left_anti"), "feedback")
    wanted = seen.select("term").distinct()
    df = index.docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n = float(index.totals[0])
    size = best.groupBy("query_id").agg(F.count("*").alias("depth"))
    score = {
        "idf": F.log(F.lit(n) / F.col("df")),
        "tf": F.col("tf").cast("double"),
        "rsv": F.col("r") * F.log(((F.col("r") + 0.5) * (n - F.col("df") - F.col("depth") + F.col("r") + 0.5)) / ((F.col("df") - F.col("r") + 0.5) * (F.col("depth") - F.col("r") + 0.5))),
    }[expander.method]
    scored = seen.join(df, "term").join(size, "query_id").select("query_id", "term", score.alias("score"))
    return ranked(scored, expander.terms, id_col="term")


def expand_simple(terms: DataFrame, more: DataFrame) -> DataFrame:
    """(query_id, terms) with the terms of ``more`` (query_id, term) behind the query's own."""
    added = more.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("more"))
    return terms.join(added, "query_id", "left").select("query_id", F.concat("terms", F.coalesce("more", F.array().cast("array<string>"))).alias("terms"))


def retrieve_with_feedback(index: LexicalIndex, queries: DataFrame, first_k: int = 100, k: int = 10, expander: Expander = Expander(), params: Bm25Params = Bm25Params(), retrieve=None) -> DataFrame:
    """query_id, doc_id, score, rank of the expanded queries. ``retrieve(queries, k)`` replaces BM25 if given."""
    retrieve = retrieve or (lambda q, n: index.bm25(q, n, params))
    first = materialize(retrieve(queries, max(first_k, expander.depth)), "feedback")
    return retrieve(expand_simple(queries, expansion_terms(index, queries, first, expander)), k)
