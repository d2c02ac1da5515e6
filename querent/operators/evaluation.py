"""Retrieval quality: ranked runs (query_id, doc_id, rank) against judgments (query_id, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTAS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rows of the run with rel (0 if not judged); of repeated judgments the highest counts."""
    best = qrels.groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))
    return run.select("query_id", "doc_id", "rank").join(best, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def binary_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision, recall, ndcg (all at k), average_precision, reciprocal_rank; 0 without results or relevant documents."""
    relevant = qrels.filter("rel > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant"))
    rows = _judged(run, qrels).withColumn("hit", (F.col("rel") > 0).cast("int"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hits", F.sum("hit").over(upto))
    gain = F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    sums = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("at_k"),
        F.sum(gain).alias("dcg"),
        F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("precisions"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    every = qrels.select("query_id").distinct().join(sums, "query_id", "left").join(relevant, "query_id", "left")
    return every.select(
        "query_id",
        zero(F.col("at_k") / F.lit(float(k))).alias("precision"),
        zero(F.col("at_k") / F.col("relevant")).alias("recall"),
        zero(F.when(F.col("relevant") > 0, F.col("dcg") / ideal)).alias("ndcg"),
        zero(F.col("precisions") / F.col("relevant")).alias("average_precision"),
        zero(1 / F.col("first")).alias("reciprocal_rank"),
    )


def graded_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, highest: int | None = None) -> DataFrame:
    """query_id, ndcg (gains 2**rel - 1) and err at k. ``highest`` is the top grade (found in qrels if not
    given); higher ones count as it in err."""
    top = highest if highest is not None else (qrels.agg(F.max("rel")).first()[0] or 0)
    best = qrels.groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain).alias("ideal"))
    rows = _judged(run, qrels).filter(F.col("rank") <= k)
    stop = (F.pow(F.lit(2.0), F.least(F.col("rel"), F.lit(top))) - 1) / F.lit(2.0**top)
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    go_on = F.coalesce(F.exp(F.sum(F.log(1 - stop)).over(before)), F.lit(1.0))
    rows = rows.withColumn("err_part", stop * go_on / F.col("rank")).withColumn("gain", gain)
    sums = rows.groupBy("query_id").agg(F.sum("gain").alias("dcg"), F.sum("err_part").alias("err"))
    every = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(sums, "query_id", "left")
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))
    return every.select("query_id", F.coalesce(ndcg, F.lit(0.0)).alias("ndcg"), F.coalesce("err", F.lit(0.0)).alias("err"))


def neighbour_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, recall: shared ids over min(k, size of the truth), of results (query_id, doc_id, rank)."""
    t = truth.filter(F.col("rank") <= k).select("query_id", "doc_id")
    f = found.filter(F.col("rank") <= k).select("query_id", "doc_id").withColumn("hit", F.lit(1))
    rows = t.join(f, ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def robustness(recalls: DataFrame, deltas: tuple[float, ...] = DELTAS) -> DataFrame:
    """delta, share: the share of queries whose recall reaches delta."""
    each = F.explode(F.array(*[F.lit(d) for d in deltas])).alias("delta")
    return recalls.select("recall", each).groupBy("delta").agg(F.avg((F.col("recall") >= F.col("delta")).cast("double")).alias("share"))


def statistics(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """mean, std (of the population), min, max and p50, p95, p99 by nearest rank, over all or ``by`` groups."""
    keys = [by] if by else []
    rows = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    rows = rows if by else rows.withColumn("all", F.lit(0))
    key = by or "all"
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    counted = rows.groupBy(key, "v").agg(F.count("*").alias("times"))  # ranks from counts of values, not from every row
    order = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("times").over(order)).join(sums.select(key, "n"), key)
    pick: list[Column] = []
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        at = F.floor(F.lit(p) * (F.col("n") - 1) + 0.5)
        pick.append(F.min(F.when(F.col("upto") > at, F.col("v"))).alias(name))
    out = sums.join(placed.groupBy(key).agg(*pick), key)
    return out if by else out.drop("all")
