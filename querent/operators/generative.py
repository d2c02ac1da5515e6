"""Generative retrieval: identifiers from a model, scored by their occurrence in passages; learning-to-rank losses."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.operators.topk import ranked

VIEWS = ("title", "substring", "pseudo_query")
BEAM, LEAST = 15, 3


class AutoregressiveModel(Protocol):
    """Gives (query_id, view, identifier, weight) for queries (query_id, text)."""

    def generate(self, queries: DataFrame, beam: int) -> DataFrame: ...


class IdentifierGenerator(Protocol):
    """Gives identifiers of passages: (doc_id, title, substring, pseudo_query) for (doc_id, text); see ``passage_identifiers``."""

    def __call__(self, passages: DataFrame) -> DataFrame: ...


class WordModel:
    """A stand-in without a network: identifiers from the query's words of more than two bytes."""

    def generate(self, queries: DataFrame, beam: int = BEAM) -> DataFrame:
        words = F.filter(F.split("text", r"\s+"), lambda w: F.octet_length(w) > 2)
        rows = queries.select("query_id", F.posexplode(F.slice(words, 1, beam)).alias("i", "w"))
        forms = F.array(
            F.struct(F.lit("title").alias("view"), F.concat(F.upper("w"), F.lit(" Topic")).alias("identifier")),
            F.struct(F.lit("substring").alias("view"), F.concat("w", F.lit(" is a key concept")).alias("identifier")),
            F.struct(F.lit("pseudo_query").alias("view"), F.concat(F.lit("what is "), "w").alias("identifier")),
        )
        made = rows.select("query_id", F.explode(forms).alias("f"), (F.lit(10.0) - 0.5 * F.col("i")).alias("weight")).select("query_id", "f.view", "f.identifier", "weight")
        bare = queries.filter(F.size(words) == 0).select("query_id", F.explode(F.array(*map(F.lit, VIEWS))).alias("view"))
        return made.unionByName(bare.select("query_id", "view", F.concat("view", F.lit(" result")).alias("identifier"), F.lit(5.0).alias("weight")))


def score_passages(passages: DataFrame, identifiers: DataFrame, k: int | None = None, case_sensitive: bool = False, least: int = LEAST) -> DataFrame:
    """query_id, doc_id, score, rank: for each passage (doc_id, text) the weights of the identifiers (query_id, identifier,
    weight) it contains; of repeated identifiers the highest weight counts, shorter ones than ``least`` bytes don't, and
    passages without any stay with score 0."""
    fold = (lambda c: c) if case_sensitive else F.lower
    once = identifiers.groupBy("query_id", "identifier").agg(F.max("weight").alias("weight"))
    packed = once.filter(F.octet_length("identifier") >= least).groupBy("query_id").agg(F.collect_list(F.struct(fold(F.col("identifier")).alias("t"), F.col("weight").alias("w"))).alias("ids"))
    every = identifiers.select("query_id").distinct().join(packed, "query_id", "left")
    rows = passages.select("doc_id", fold(F.coalesce("text", F.lit(""))).alias("body")).crossJoin(every)  # stated queries, one row each
    hits = F.aggregate(F.coalesce("ids", F.array().cast("array<struct<t:string,w:double>>")), F.lit(0.0), lambda acc, x: acc + F.when(F.contains(F.col("body"), x["t"]), x["w"]).otherwise(0.0))
    return ranked(rows.select("query_id", "doc_id", hits.alias("score")), k)


def matching_identifiers(passages: DataFrame, identifiers: DataFrame) -> DataFrame:
    """query_id, doc_id, identifier, weight: which identifiers each passage contains."""
    rows = passages.select("doc_id", F.lower("text").alias("body")).crossJoin(identifiers.groupBy("query_id", "identifier").agg(F.max("weight").alias("weight")))
    return rows.filter((F.octet_length("identifier") >= LEAST) & F.contains(F.col("body"), F.lower("identifier"))).select("query_id", "doc_id", "identifier", "weight")


def retrieve(passages: DataFrame, queries: DataFrame, model: AutoregressiveModel | None = None, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, doc_id, score, rank by the identifiers that the model makes of the queries (query_id, text)."""
    return score_passages(passages, (model or WordModel()).generate(queries, beam), k)


def passage_identifiers(passages: DataFrame, most: int = 100, longest: int = 200) -> DataFrame:
    """doc_id, title, substring, pseudo_query of passages (doc_id, text), cut by characters.

    The title is the first line if shorter than ``longest``, else the first sentence if shorter, else 50 characters; the
    substring starts a quarter in if the text is long enough; the pseudo-query has the five most frequent words of
    more than three bytes, of ties the smaller first.
    """
    t = F.coalesce("text", F.lit(""))
    line, sentence = F.trim(F.substring_index(t, "\n", 1)), F.trim(F.substring_index(t, ".", 1))
    fits = lambda c: (F.char_length(c) < longest) & (c != "")
    title = F.when(fits(line), line).when(fits(sentence), sentence).otherwise(F.trim(F.substring(t, 1, 50)))
    n = F.char_length(t)
    start = F.when(n > 2 * most, F.floor(n / 4)).otherwise(0).cast("int")
    words = F.explode(F.split(F.lower(t), "[^a-z0-9]+"))
    counts = passages.select("doc_id", words.alias("w")).filter(F.octet_length("w") > 3).groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    best = counts.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "w"))).filter("at <= 5")
    best = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("b"))
    rows = passages.select("doc_id", title.alias("title"), F.trim(F.substr(t, start + 1, F.lit(most))).alias("substring")).join(best, "doc_id", "left")
    return rows.select("doc_id", "title", "substring", F.coalesce(F.array_join(F.transform("b", lambda x: x["w"]), " "), F.lit("")).alias("pseudo_query"))


@dataclass(frozen=True)
class LtrConfig:
    margin: float = 500.0
    weight: float = 1000.0
    top_k: int = 200
    most_identifiers: int = 40


def rank_loss(positive: Column, negative: Column, margin: float = 500.0) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) + negative - positive)


def rank_losses(scored: DataFrame, config: LtrConfig = LtrConfig(), seed: int = 0) -> DataFrame:
    """query_id, loss1, loss2 from (query_id, doc_id, score, relevant): best positive against best negative, and one pair
    of each query chosen by a seeded hash; 0 where a side is missing."""
    rows = scored.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("at") <= config.top_k)
    side = lambda flag, value: F.when(F.col("relevant") == F.lit(flag), value)
    draw = F.struct(F.xxhash64(F.lit(seed), "query_id", "doc_id").alias("h"), F.col("score").alias("s"))
    best = rows.groupBy("query_id").agg(F.max(side(True, F.col("score"))).alias("p"), F.max(side(False, F.col("score"))).alias("n"), F.min(side(True, draw)).alias("pd"), F.min(side(False, draw)).alias("nd"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    missing = F.col("p").isNull() | F.col("n").isNull()
    loss = lambda p, n: F.when(missing, 0.0).otherwise(zero(rank_loss(p, n, config.margin)))
    return best.select("query_id", loss(F.col("p"), F.col("n")).alias("loss1"), loss(F.col("pd.s"), F.col("nd.s")).alias("loss2"))


def total_loss(loss1: Column, loss2: Column, generation: Column, config: LtrConfig = LtrConfig()) -> Column:
    return loss1 + loss2 + F.lit(config.weight) * generation
