"""Benchmark data sets, a runner and reports."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.operators import dense
from querent.operators.evaluation import neighbour_recall
from querent.runtime import materialize

#: Rows and dimensions of the usual data sets; generated vectors stand in for them.
SHAPES = {"sift1m": (1_000_000, 128), "glove": (1_200_000, 100), "mnist": (60_000, 784), "nytimes": (290_000, 256)}


def synthetic(spark: SparkSession, rows: int, dimension: int, seed: int = 42) -> DataFrame:
    """(doc_id, embedding): unit vectors from a hash of id and place, the same in any partitioning."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), "doc_id", i), F.lit(2_000_001)) / 1_000_000.0 - 1.0
    raw = spark.range(rows).withColumnRenamed("id", "doc_id").withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(dimension)), draw))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return raw.select("doc_id", F.transform("v", lambda x: (x / length).cast("float")).alias("embedding"))


def split(vectors: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): one in ten for more than 10,000 rows, else one in five, is a test row, by a hash of the id."""
    part = F.pmod(F.xxhash64(F.lit("split"), "doc_id"), F.lit(10 if rows > 10_000 else 5)) == 0
    return vectors.filter(~part), vectors.filter(part).select(F.col("doc_id").alias("query_id"), "embedding")


def standard(spark: SparkSession, name: str, small: bool = True) -> tuple[DataFrame, DataFrame]:
    rows, dimension = SHAPES[name]
    rows = max(1000, rows // 10) if small else rows
    return split(synthetic(spark, rows, dimension), rows)


@dataclass
class Runner:
    """Builds indexes on train vectors and measures recall and throughput on the test vectors."""

    train: DataFrame
    test: DataFrame
    ks: tuple[int, ...] = (1, 10, 100)
    results: list[dict] = field(default_factory=list)

    def run(self, name: str, index) -> list[dict]:
        train, test = materialize(self.train, "bench"), materialize(self.test, "bench")
        n = max(1, test.count())
        began = time.time()
        built = index.build(train)
        build_s = time.time() - began
        for k in self.ks:
            truth = materialize(dense.search_blocks(train, test, k), "bench")
            began = time.time()
            found = materialize(built.search(test, k), "bench")
            took = time.time() - began
            recall = neighbour_recall(truth, found, k).agg(F.avg("recall")).first()[0]
            self.results.append({"algorithm": name, "k": k, "recall": float(recall or 0.0), "queries_per_s": n / took, "build_s": build_s})
        return self.results

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c] for c in ("algorithm", "k", "recall", "queries_per_s", "build_s")) for r in self.results], "algorithm string, k int, recall double, queries_per_s double, build_s double")


def summary(results: DataFrame) -> DataFrame:
    """algorithm, best_recall, best_queries_per_s."""
    return results.groupBy("algorithm").agg(F.max("recall").alias("best_recall"), F.max("queries_per_s").alias("best_queries_per_s"))


def by_k(results: DataFrame) -> DataFrame:
    """k and, as columns named by algorithm, the recall that each reaches."""
    return results.groupBy("k").pivot("algorithm").agg(F.max("recall")).orderBy("k")


def plot(results: DataFrame, k: int, width: int = 40) -> str:
    """Recall against throughput at k as text: a line an algorithm, its bar as long as its recall."""
    rows = results.filter(F.col("k") == k).groupBy("algorithm").agg(F.max("recall").alias("recall"), F.max("queries_per_s").alias("rate")).orderBy("algorithm").collect()  # one an algorithm
    name = max((len(r["algorithm"]) for r in rows), default=0)
    return "\n".join(f"{r['algorithm']:<{name}} {'#' * round(width * r['recall']):<{width}} {r['recall']:.3f} at {r['rate']:.1f} queries/s" for r in rows)


def write_csv(results: DataFrame, path: str) -> None:
    results.write.option("header", True).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.json(path)
