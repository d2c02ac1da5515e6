"""Lexical retrieval: term statistics, BM25 and variants, TF-IDF, query likelihood, precomputed scores.

Queries are a DataFrame (query_id, terms array<string>). Only postings of query terms are ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.errors import EmptyQuery, InvalidParameter
from querent.functions.text import tokens
from querent.operators.topk import DECIMALS, ranked
from querent.runtime import materialize, spread


@dataclass(frozen=True)
class Bm25Params:
    """variant: standard, l (adds delta to each matching term's part, 0.5 if not given) or plus (1.0)."""

    k1: float = 1.2
    b: float = 0.75
    variant: str = "standard"
    delta: float | None = None

    @property
    def added(self) -> float:
        if self.variant not in ("standard", "l", "plus"):
            raise InvalidParameter(f"unknown variant {self.variant}")
        return {"standard": 0.0, "l": 0.5, "plus": 1.0}[self.variant] if self.delta is None or self.variant == "standard" else self.delta


@dataclass(frozen=True)
class TfIdfParams:
    """tf: log (1 + ln tf) or linear; idf: standard (ln N/df) or smoothed."""

    tf: str = "log"
    idf: str = "standard"


@dataclass(frozen=True)
class Smoothing:
    """dirichlet (parameter mu, 1000) or jelinek_mercer (lambda, 0.5, clamped to 0..1). With mu 0 nothing is smoothed: terms
    that a document lacks have no probability and are left out, as with lambda 1."""

    kind: str = "dirichlet"
    value: float = 1000.0

    @staticmethod
    def jelinek_mercer(lam: float = 0.5) -> Smoothing:
        return Smoothing("jelinek_mercer", min(1.0, max(0.0, lam)))

    @staticmethod
    def dirichlet(mu: float = 1000.0) -> Smoothing:
        return Smoothing("dirichlet", max(0.0, mu))


def query_terms(spark: SparkSession, queries: dict[int, str] | dict[int, list[str]]) -> DataFrame:
    """(query_id, terms) from a driver-side dictionary; a string is split as texts are."""
    import re

    rows = [(int(i), [t for t in re.split("[^a-z0-9]+", q.lower()) if t] if isinstance(q, str) else list(q)) for i, q in queries.items()]
    if any(not terms for _, terms in rows):
        raise EmptyQuery("a query has no terms")
    return spark.createDataFrame(rows, "query_id long, terms array<string>")


class LexicalIndex:
    """Term statistics over (doc_id, terms). An id that occurs more than once is one document with all its terms."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "terms")
        self._matched: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def from_texts(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        return cls(rows.select("doc_id", tokens("text").alias("terms")))

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf)."""
        return self.docs.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        """(doc_id, dl)."""
        return self.docs.select("doc_id", F.size("terms").cast("long").alias("dl"))

    @property
    def term_stats(self) -> DataFrame:
        """(term, df, cf)."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Number of documents and of tokens: one row, computed once."""
        row = self.lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return int(row[0]), int(row[1])

    @property
    def average_length(self) -> float:
        n, total = self.totals
        return total / n if n else 0.0

    def vocabulary(self) -> DataFrame:
        """(term, term_id): ids from 0 in the order of terms, by range partitions and offsets, without one global window."""
        terms = materialize(self.docs.select(F.explode("terms").alias("term")).distinct().repartitionByRange("term").withColumn("part", F.spark_partition_id()), "vocabulary")
        from pyspark.sql import Window

        local = F.row_number().over(Window.partitionBy("part").orderBy("term"))
        sizes = terms.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return terms.withColumn("local", local).join(sizes.select("part", before.alias("before")), "part").select("term", (F.col("before") + F.col("local") - 1).alias("term_id"))

    def matches(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qtf, doc_id, tf, dl, df, cf) of query terms and documents that have them; those of the last
        queries are kept, as several models are often asked the same."""
        if self._matched is None or self._matched[0] is not queries:
            self._matched = (queries, self._match(queries))
        return self._matched[1]

    def _match(self, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        wanted = asked.select("term").distinct()
        rows = self.docs.select("doc_id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
        postings = materialize(rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")), "postings")
        stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        return asked.join(stats, "term").join(postings, "term")

    def bm25_idf(self, df: Column) -> Column:
        n = self.totals[0]
        return F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)

    def bm25_part(self, p: Bm25Params) -> Column:
        """A term's part of the score, for one occurrence in the query."""
        length = F.lit(1 - p.b) + F.lit(p.b) * F.col("dl") / F.lit(self.average_length)
        saturated = F.col("tf") * (p.k1 + 1) / (F.col("tf") + F.lit(p.k1) * length)
        return self.bm25_idf(F.col("df")) * (saturated + p.added)

    def bm25(self, queries: DataFrame, k: int | None = 10, params: Bm25Params = Bm25Params()) -> DataFrame:
        """query_id, doc_id, score, rank; documents with a positive score only."""
        scores = self.matches(queries).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * self.bm25_part(params)).alias("score"))
        return ranked(scores.filter("score > 0 AND NOT isnan(score)"), k)

    def bm25_score(self, queries: DataFrame, docs: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
        """query_id, doc_id, score of every query and every one of ``docs`` (doc_id), stated sets both; 0 without a common term."""
        wanted = docs.select("doc_id").distinct()
        parts = self.matches(queries).join(wanted, "doc_id", "left_semi").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * self.bm25_part(params)).alias("score"))
        every = queries.select("query_id").distinct().crossJoin(wanted)
        return every.join(parts, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce(F.round("score", DECIMALS), F.lit(0.0)).alias("score"))

    def tfidf(self, queries: DataFrame, k: int | None = 10, params: TfIdfParams = TfIdfParams()) -> DataFrame:
        """query_id, doc_id, score, rank; scores of 0 stay."""
        n = float(self.totals[0])
        tf = F.col("tf").cast("double") if params.tf == "linear" else 1 + F.log("tf")
        idf = F.log(F.lit(n) / F.col("df")) if params.idf == "standard" else F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        scores = self.matches(queries).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * tf * idf).alias("score"))
        return ranked(scores, k)

    def query_likelihood(self, queries: DataFrame, k: int | None = 10, smoothing: Smoothing = Smoothing()) -> DataFrame:
        """query_id, doc_id, score, rank; log probabilities of the query under each document's smoothed model.

        Documents with a query term are candidates, all documents where a query matches none; query terms that no
        document has are left out. A document's sum over absent terms follows from the query and its length alone.
        """
        total = float(self.totals[1])
        found = materialize(self.matches(queries), "likelihood")
        p = F.col("cf") / F.lit(total)
        terms = found.select("query_id", "term", "qtf", p.alias("p")).distinct()
        v = F.lit(float(smoothing.value))
        per_query = terms.groupBy("query_id").agg(F.sum("qtf").alias("m"), F.sum(F.col("qtf") * F.log("p")).alias("logs"))
        if smoothing.kind == "dirichlet" and smoothing.value > 0:
            present = F.log(F.col("tf") + v * p) - F.log(v * p)
            absent = F.col("logs") + F.col("m") * F.log(v) - F.col("m") * F.log(F.col("dl") + v)
        elif smoothing.kind == "dirichlet" or smoothing.value >= 1:
            present, absent = F.log(F.col("tf") / F.col("dl")), F.lit(0.0)
        else:
            present = F.log(v * F.col("tf") / F.col("dl") + (1 - v) * p) - F.log((1 - v) * p)
            absent = F.col("logs") + F.col("m") * F.log(1 - v)
        sums = found.groupBy("query_id", "doc_id", "dl").agg(F.sum(F.col("qtf") * present).alias("have"))
        scores = sums.join(per_query, "query_id").select("query_id", "doc_id", (F.col("have") + absent).alias("score"))
        none = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
        fallback = none.crossJoin(self.docs.select("doc_id")).withColumn("score", F.lit(0.0))  # only for queries without matches
        return ranked(scores.unionByName(fallback), k)

    def eager(self, params: Bm25Params = Bm25Params()) -> EagerIndex:
        """Precompute every posting's BM25 part."""
        rows = self.postings.join(self.lengths, "doc_id")
        stats = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        return EagerIndex(rows.join(stats, "term").select("term", "doc_id", self.bm25_part(params).alias("score")))


class StoredIndex(LexicalIndex):
    """An index over stored postings (term, doc_id, tf) and lengths (doc_id, dl): queries read the postings of their terms."""

    def __init__(self, postings: DataFrame, lengths: DataFrame):
        self._postings, self._lengths = postings.select("term", "doc_id", "tf"), lengths.select("doc_id", "dl")
        self._matched = None

    @property
    def docs(self) -> DataFrame:
        """(doc_id, terms), terms in no order: for what asks for whole documents, such as feedback."""
        rows = self._postings.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms"))
        return self._lengths.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))

    @property
    def postings(self) -> DataFrame:
        return self._postings

    @property
    def lengths(self) -> DataFrame:
        return self._lengths

    def _match(self, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        rows = self._postings.join(asked.select("term").distinct(), "term", "left_semi")
        postings = materialize(rows.join(self._lengths, "doc_id").select("term", "doc_id", "dl", "tf"), "postings")
        stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        return asked.join(stats, "term").join(postings, "term")


class EagerIndex:
    """Stored scores (term, doc_id, score); a query's score is the sum over its distinct terms."""

    def __init__(self, scores: DataFrame):
        self.scores = scores.select("term", "doc_id", "score")

    def save(self, path: str, buckets: int = 64) -> None:
        """Clustered by term, so that a query's terms are found by Parquet's row group statistics."""
        self.scores.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EagerIndex:
        return cls(spark.read.parquet(path))

    def retrieve(self, queries: DataFrame, k: int | None = 10) -> DataFrame:
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
        return ranked(asked.join(self.scores, "term").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")).filter("score > 0"), k)
