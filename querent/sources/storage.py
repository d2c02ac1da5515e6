"""Stored indexes: segments as Parquet, a log of changes, checkpoints, and recovery.

A store is a folder with ``segments/postings/segment_id=<id>/`` (clustered by term) and ``segments/lengths/segment_id=<id>/``,
``log/epoch=<n>/`` (events as Parquet, one row an event; a checkpoint begins an epoch) and ``checkpoints/<n>/`` (the live
segments and deletions as of event n). The state is a fold over the last checkpoint and the events behind it; earlier
ones aren't read. Spark's committed writes replace locks and checksums: what isn't committed isn't seen. One writer at
a time numbers events; a second one that takes the same number is found by ``duplicated``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.errors import EmptyIndex, InvalidParameter
from querent.operators.lexical import LexicalIndex, StoredIndex
from querent.runtime import children, materialize, remove_path

EVENT = "entry_id long, kind string, segment_id long, transaction_id long, segment_ids array<long>, new_segment_id long, deletes array<struct<segment_id:long,doc_id:long>>, doc_count int, checkpoint_path string"
KINDS = ("add_segment", "start_merge", "cancel_merge", "end_merge", "delete_documents", "checkpoint")


def live_segments(events: DataFrame) -> DataFrame:
    """(segment_id): segments added or merged into, less those that a finished merge replaced. A fold over the last event
    of each segment, so the order in which events are read doesn't matter."""
    added = events.filter("kind = 'add_segment'").select("segment_id", "entry_id", F.lit(True).alias("live"))
    merged = events.filter("kind = 'end_merge'")
    made = merged.select(F.col("new_segment_id").alias("segment_id"), "entry_id", F.lit(True).alias("live"))
    gone = merged.select(F.explode("segment_ids").alias("segment_id"), "entry_id", F.lit(False).alias("live"))
    last = added.unionByName(made).unionByName(gone).groupBy("segment_id").agg(F.max_by("live", F.struct("entry_id", F.col("live").cast("int").alias("l"))).alias("live"))
    return last.filter("live").select("segment_id")


def deletions(events: DataFrame) -> DataFrame:
    """(segment_id, doc_id) of live segments: a merge leaves its segments' deleted documents out, and so ends their deletions."""
    every = events.filter("kind = 'delete_documents'").select(F.explode("deletes").alias("d")).select("d.segment_id", "d.doc_id").distinct()
    return every.join(live_segments(events), "segment_id", "left_semi")


def open_merges(events: DataFrame) -> DataFrame:
    """(transaction_id): merges that were started and neither cancelled nor ended."""
    ended = events.filter("kind IN ('cancel_merge', 'end_merge')").select("transaction_id").distinct()
    return events.filter("kind = 'start_merge'").select("transaction_id").distinct().join(ended, "transaction_id", "left_anti")


@dataclass
class SegmentStore:
    """A lexical index in segments. One writer at a time numbers events."""

    spark: SparkSession
    path: str

    def checkpoints(self) -> list[int]:
        """The events of the committed checkpoints, in order."""
        done = [n for n in children(self.spark, f"{self.path}/checkpoints") if n.isdigit() and "_SUCCESS" in children(self.spark, f"{self.path}/checkpoints/{n}/done")]
        return sorted(map(int, done))

    def _logged(self, since: int = 0) -> DataFrame:
        """The events in the log from an epoch on."""
        if not children(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], EVENT)
        rows = self.spark.read.schema(f"{EVENT}, epoch long").parquet(f"{self.path}/log")
        return rows.filter(F.col("epoch") >= since).drop("epoch")

    def events(self) -> DataFrame:
        """What the state is made of: the last checkpoint as events, and those behind it."""
        at = self.checkpoints()[-1:]
        if not at:
            return self._logged()
        folder = f"{self.path}/checkpoints/{at[0]}"
        # What a merge is to replace again is older than every event behind the checkpoint.
        kept = self.spark.read.schema("segment_id long, doc_count int").parquet(f"{folder}/segments")
        kept = kept.select(F.lit(at[0]).cast("long").alias("entry_id"), F.lit("add_segment").alias("kind"), "segment_id", "doc_count")
        gone = self.spark.read.schema("segment_id long, doc_id long").parquet(f"{folder}/deletions")
        gone = gone.select(F.lit(at[0]).cast("long").alias("entry_id"), F.lit("delete_documents").alias("kind"), F.array(F.struct("segment_id", "doc_id")).alias("deletes"))
        rest = self._logged(at[0]).unionByName(kept, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
        return rest.select(*self._logged(at[0]).columns)

    def _next(self) -> int:
        return max(self.events().agg(F.max("entry_id")).first()[0] or 0, *self.checkpoints()[-1:], 0) + 1

    def _next_segment(self) -> int:
        """Segments are numbered by the folders there are, also of those that merges have replaced or that no event names."""
        return max([int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/segments/lengths") if n.startswith("segment_id=")], default=0) + 1

    def append(self, kind: str, **fields) -> int:
        """Write one event; returns its number."""
        if kind not in KINDS:
            raise InvalidParameter(f"unknown event {kind}")
        number, epoch = self._next(), (self.checkpoints() or [0])[-1]
        names = [f.split()[0] for f in ("entry_id", "kind", "segment_id", "transaction_id", "segment_ids", "new_segment_id", "deletes", "doc_count", "checkpoint_path")]
        row = tuple({"entry_id": number, "kind": kind, **fields}.get(n) for n in names)
        self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(f"{self.path}/log/epoch={epoch}")
        return number

    def duplicated(self) -> DataFrame:
        """(entry_id): numbers that two writers gave at a time."""
        # A checkpoint carries unfinished merges over under their numbers, so they count within an epoch.
        rows = self.spark.read.schema(f"{EVENT}, epoch long").parquet(f"{self.path}/log")
        return rows.groupBy("epoch", "entry_id").agg(F.count("*").alias("n")).filter("n > 1").select("entry_id")

    def _write(self, segment: int, postings: DataFrame, lengths: DataFrame, partitions: int) -> None:
        postings.repartitionByRange(partitions, "term").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.path}/segments/postings/segment_id={segment}")
        lengths.write.parquet(f"{self.path}/segments/lengths/segment_id={segment}")

    def add_segment(self, docs: DataFrame, partitions: int = 8, transaction: int | None = None) -> int:
        """Store (doc_id, terms) as a new segment; returns its id."""
        segment, index = self._next_segment(), LexicalIndex(docs)
        self._write(segment, index.postings, index.lengths, partitions)
        count = self.spark.read.parquet(f"{self.path}/segments/lengths/segment_id={segment}").count()
        self.append("add_segment", segment_id=segment, transaction_id=transaction, doc_count=count)
        return segment

    def delete(self, segment: int, doc_ids: list[int]) -> int:
        return self.append("delete_documents", deletes=[(segment, int(i)) for i in doc_ids])

    def live(self) -> list[int]:
        return [r["segment_id"] for r in live_segments(self.events()).orderBy("segment_id").collect()]  # one row a segment

    def _read(self, part: str, segments: list[int] | None = None) -> DataFrame:
        """Live rows of a part of the segments; a deletion holds in its segment alone."""
        events = self.events()
        segments = self.live() if segments is None else segments
        if not segments:
            raise EmptyIndex("the store has no segments")
        rows = self.spark.read.option("basePath", f"{self.path}/segments/{part}").parquet(*[f"{self.path}/segments/{part}/segment_id={s}" for s in segments])
        rows = rows.withColumn("segment_id", F.col("segment_id").cast("long"))
        return rows.join(deletions(events), ["segment_id", "doc_id"], "left_anti").drop("segment_id")

    def postings(self, prefix: str | None = None) -> DataFrame:
        """(term, doc_id, tf) of live documents; terms with ``prefix`` only are read by row group statistics."""
        rows = self._read("postings").select("term", "doc_id", "tf")
        return rows if prefix is None else rows.filter(F.col("term").startswith(prefix))

    def lengths(self) -> DataFrame:
        return self._read("lengths").select("doc_id", "dl")

    def terms(self, prefix: str | None = None) -> DataFrame:
        """(term, df, cf)."""
        return self.postings(prefix).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def index(self) -> StoredIndex:
        """The stored index, ready for queries, which read the postings of their terms."""
        return StoredIndex(self.postings(), self.lengths())

    def merge(self, segments: list[int], partitions: int = 8) -> int:
        """Replace segments by one without their deleted documents; returns its id."""
        if set(segments) - set(self.live()):
            raise InvalidParameter("only live segments are merged")
        started = self._next()
        self.append("start_merge", transaction_id=started, segment_ids=segments)
        target = self._next_segment()
        self._write(target, self._read("postings", segments).select("term", "doc_id", "tf"), self._read("lengths", segments).select("doc_id", "dl"), partitions)
        count = self.spark.read.parquet(f"{self.path}/segments/lengths/segment_id={target}").count()
        self.append("end_merge", transaction_id=started, segment_ids=segments, new_segment_id=target, doc_count=count)
        return target

    def checkpoint(self) -> str:
        """Write the live segments and deletions, after which earlier events aren't read any more; returns the path."""
        number, events = self._next(), self.events()
        path = f"{self.path}/checkpoints/{number}"
        counts = events.filter("kind = 'add_segment'").select("segment_id", "doc_count").unionByName(events.filter("kind = 'end_merge'").select(F.col("new_segment_id").alias("segment_id"), "doc_count"))
        counts.join(live_segments(events), "segment_id", "left_semi").dropDuplicates(["segment_id"]).write.parquet(f"{path}/segments")
        deletions(events).write.parquet(f"{path}/deletions")
        # Unfinished merges go on behind the checkpoint as what they were.
        pending = materialize(events.filter("kind = 'start_merge'").join(open_merges(events), "transaction_id", "left_semi"), "merges")
        pending.select(*events.columns).write.mode("append").parquet(f"{self.path}/log/epoch={number}")
        self.spark.createDataFrame([(number,)], "entry_id long").coalesce(1).write.parquet(f"{path}/done")
        self.append("checkpoint", checkpoint_path=path)
        return path

    def inconsistent(self) -> DataFrame:
        """(segment_id, wanted, found): live segments whose stored documents differ in number from their event's, or are gone (0)."""
        events = self.events()
        wanted = events.filter("kind = 'add_segment'").select("segment_id", F.col("doc_count").alias("wanted")).unionByName(events.filter("kind = 'end_merge'").select(F.col("new_segment_id").alias("segment_id"), F.col("doc_count").alias("wanted")))
        wanted = wanted.join(live_segments(events), "segment_id", "left_semi")
        there = children(self.spark, f"{self.path}/segments/lengths")
        paths = [f"{self.path}/segments/lengths/segment_id={s}" for s in self.live() if f"segment_id={s}" in there]
        found = self.spark.createDataFrame([], "segment_id long, found long")
        if paths:
            rows = self.spark.read.option("basePath", f"{self.path}/segments/lengths").parquet(*paths)
            found = rows.groupBy(F.col("segment_id").cast("long").alias("segment_id")).agg(F.count("*").alias("found"))
        out = wanted.join(found, "segment_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
        return out.filter("wanted <> found").select("segment_id", "wanted", "found")

    def cleanup(self) -> list[str]:
        """Remove what the state doesn't need: segments that aren't live (also those of writers that died before their event),
        epochs before the last checkpoint and earlier checkpoints. Returns the paths. Not beside a writer."""
        live, last = set(self.live()), (self.checkpoints() or [0])[-1]
        gone = [f"{self.path}/segments/{part}/{n}" for part in ("postings", "lengths") for n in children(self.spark, f"{self.path}/segments/{part}") if n.startswith("segment_id=") and int(n.partition("=")[2]) not in live]
        gone += [f"{self.path}/log/{n}" for n in children(self.spark, f"{self.path}/log") if n.startswith("epoch=") and int(n.partition("=")[2]) < last]
        gone += [f"{self.path}/checkpoints/{n}" for n in children(self.spark, f"{self.path}/checkpoints") if n.isdigit() and int(n) != last]
        for path in gone:
            remove_path(self.spark, path)
        return gone


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(doc_id, embedding) with norms, clustered by id."""
    from querent.functions.vectors import norm

    vectors.select("doc_id", "embedding", norm("embedding").alias("norm")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
