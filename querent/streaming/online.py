"""Structured Streaming: codebooks that follow a stream of vectors, and an index log fed by a stream of documents."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querent.functions.text import tokens
from querent.operators.ann.base import sample, unit
from querent.operators.ann.quantize import OnlineProductQuantizer


def follow(vectors: DataFrame, quantizer: OnlineProductQuantizer, checkpoint: str, per_step: int = 1000) -> StreamingQuery:
    """Update ``quantizer`` with every vector of every micro-batch of the stream (doc_id, embedding), in the order of ids and
    ``per_step`` at a time; the first batch starts it on a sample. No more than a partition is on the driver."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.filter("embedding IS NOT NULL").persist(StorageLevel.DISK_ONLY)
        if quantizer.counts is None:
            x = sample(rows, per_step, seed=number)
            if not len(x):
                return
            quantizer.initialize(x)
        held: list = []
        for row in rows.select("doc_id", "embedding").orderBy("doc_id").toLocalIterator(prefetchPartitions=False):
            held.append(row["embedding"])
            if len(held) == per_step:
                quantizer.update_batch(unit(np.array(held, float)))
                held = []
        if held:
            quantizer.update_batch(unit(np.array(held, float)))
        rows.unpersist()

    return vectors.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, cf): running collection frequencies of a stream (doc_id, text), for output mode complete or update."""
    return docs.select(F.explode(tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


def ingest(docs: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of (doc_id, text) becomes a segment of the store, once: its number is kept in the log."""

    def step(batch: DataFrame, number: int) -> None:
        done = store.events().filter((F.col("kind") == "add_segment") & (F.col("transaction_id") == number)).limit(1).count()
        if not done and batch.take(1):
            store.add_segment(batch.select("doc_id", tokens("text").alias("terms")), transaction=number)

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
