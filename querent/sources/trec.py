"""TREC runs and judgments, and tab-separated passages, queries and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id (strings), rank, score, tag from lines "query Q0 doc rank score tag"."""
    f = F.col("f")
    rows = _fields(spark, path).filter(F.size("f") >= 6)
    return rows.select(f[0].alias("query_id"), f[2].alias("doc_id"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"), f[5].alias("tag"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id (strings), rel from lines "query 0 doc rel"."""
    f = F.col("f")
    return _fields(spark, path).filter(F.size("f") >= 4).select(f[0].alias("query_id"), f[2].alias("doc_id"), f[3].cast("int").alias("rel"))


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """Lines of a run (query_id, doc_id, rank, score), scores with six decimals."""
    return run.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    run_lines(run.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank"), tag).write.text(path)


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rel").cast("string")).alias("value"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrel_lines(qrels).write.text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, text from lines with a tab between them, as passage and query collections have."""
    return spark.read.schema("id long, text string").option("sep", "\t").option("quote", "").csv(path)
