"""Stored segments, logs, codecs, runs and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions.text import tokens
from querent.operators import dense
from querent.operators.lexical import LexicalIndex, query_terms
from querent.plans.pipeline import Plan
from querent.queries.lexical import ASKED, _base
from querent.queries.lexical import SQL as LEXICAL
from querent.queries.ranking import _TOPS
from querent.queries.vectors import _knn_sql, _queries, _vectors
from querent.runtime import fresh_path, table
from querent.sources import codecs, storage, trec


def _store(spark, d):
    """All documents in two segments, which are then merged."""
    store = storage.SegmentStore(spark, fresh_path(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id", tokens("text").alias("terms"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    one, two = store.add_segment(docs.filter(half == 0)), store.add_segment(docs.filter(half == 1))
    store.checkpoint()
    store.merge([one, two])
    return store


def stored_terms(spark, d):
    return _store(spark, d).terms("th")


def stored_search(spark, d):
    out = _store(spark, d).index().bm25(query_terms(spark, ASKED), 10)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def log_replay(spark, d):
    """The live segments, and how many documents are deleted in each, after a log made of the events table: its rows add and
    merge segments and delete documents in turn, by their ids."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(n.cast("long").alias("entry_id"), F.pmod(n, F.lit(10)).alias("turn"))
    none = lambda kind: F.lit(None).cast(kind)
    entry = F.col("entry_id")
    # Turn 0 to 5 add a segment, 6 and 7 delete from the segment added five before, 8 and 9 merge those of four and three before.
    kind = F.when(F.col("turn") <= 5, "add_segment").when(F.col("turn") <= 7, "delete_documents").otherwise("end_merge")
    deletes = F.when(F.col("turn").between(6, 7), F.array(F.struct((entry - 5).alias("segment_id"), (entry % 7).alias("doc_id")), F.struct((entry - 5).alias("segment_id"), (entry % 3).alias("doc_id"))))
    merged = F.when(F.col("turn") >= 8, F.array(entry - 4, entry - 3 - F.col("turn")))
    events = rows.select("entry_id", kind.alias("kind"), F.when(F.col("turn") <= 5, entry).alias("segment_id"), F.when(F.col("turn") >= 8, entry).alias("transaction_id"), merged.alias("segment_ids"), F.when(F.col("turn") >= 8, entry).alias("new_segment_id"), deletes.alias("deletes"), F.lit(1).alias("doc_count"), none("string").alias("checkpoint_path"))
    gone = storage.deletions(events).groupBy("segment_id").agg(F.count("*").alias("deleted"))
    return storage.live_segments(events).join(gone, "segment_id", "left").select("segment_id", F.coalesce("deleted", F.lit(0).cast("long")).alias("deleted"))


def id_sets(spark, d):
    """Documents of every term as compressed sets, their sizes, and the ids read back."""
    postings = LexicalIndex.from_texts(table(spark, d, "documents")).postings
    # A set holds the ids of one block of a million, so frequent terms make many sets and no long one.
    key = F.concat_ws("\u0001", "term", F.expr("doc_id div 1000000").cast("string"))
    sets = postings.groupBy(key.alias("key")).agg(F.collect_list("doc_id").alias("ids"))
    data = codecs.compressed(sets, 1 << 40, "elias_fano")
    back = codecs.decompressed(data, 1 << 40, "elias_fano")
    term, total = F.substring_index("key", "\u0001", 1), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.groupBy(term.alias("term")).agg(F.sum(F.size("ids")).cast("long").alias("n"), F.sum(total).alias("total"))


def gaps(spark, d):
    """Gaps of every vector's sorted multiples."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("vec_id") * i).alias("v"))
    return rows.select("vec_id", F.array_join(F.transform(codecs.gap_column("v"), lambda x: x.cast("string")), ",").alias("gaps"))


def run_file(spark, d):
    """A run written in TREC's format and read back."""
    path = fresh_path(spark, "run")
    best = LexicalIndex.from_texts(table(spark, d, "documents")).bm25(query_terms(spark, ASKED), 10)
    trec.write_run(best, path, "bm25")
    return trec.read_run(spark, path).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score", "tag")


def vectors(spark, d):
    path = fresh_path(spark, "vectors")
    storage.save_vectors(_vectors(spark, d), path)
    out = dense.search_blocks(storage.load_vectors(spark, path), _queries(spark, d), 10)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid(spark, d):
    """Two lexical retrievers fused by reciprocal ranks, as a plan."""
    index, asked = LexicalIndex.from_texts(table(spark, d, "documents")), query_terms(spark, ASKED)
    from querent.operators.lexical import TfIdfParams

    plan = Plan().retrieve("bm25", lambda k: index.bm25(asked, k), 50).retrieve("tfidf", lambda k: index.tfidf(asked, k, TfIdfParams(tf="linear", idf="smoothed")), 50)
    return plan.fuse("rrf", 20).top(5).run().select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "stored_terms": stored_terms,
    "stored_search": stored_search,
    "stored_vectors": vectors,
    "log_replay": log_replay,
    "id_sets": id_sets,
    "id_gaps": gaps,
    "trec_run": run_file,
    "hybrid_plan": hybrid,
}

SQL = {
    "stored_terms": LEXICAL["index_prefix"],
    "stored_search": LEXICAL["bm25_batch"],
    "stored_vectors": _knn_sql(),
    "log_replay": """
WITH e AS (SELECT event_id::BIGINT AS n, event_id % 10 AS turn FROM events),
x AS (SELECT n AS s, n, 1 AS live FROM e WHERE turn <= 5 OR turn >= 8
      UNION ALL SELECT n - 4, n, 0 FROM e WHERE turn >= 8 UNION ALL SELECT n - 3 - turn, n, 0 FROM e WHERE turn >= 8),
l AS (SELECT s, arg_max(live, n * 2 + live) AS live FROM x GROUP BY s),
g AS (SELECT DISTINCT n - 5 AS s, unnest([n % 7, n % 3]) AS doc FROM e WHERE turn IN (6, 7))
SELECT l.s AS segment_id, count(g.doc)::BIGINT AS deleted FROM l LEFT JOIN g ON l.s = g.s WHERE live = 1 GROUP BY l.s""",
    "id_sets": f"{_base()} SELECT term, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS total FROM tf GROUP BY term",
    "id_gaps": "SELECT vec_id, array_to_string(list_transform(range(8), lambda i: vec_id), ',') AS gaps FROM embeddings",
    "trec_run": "SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, rank, score, 'bm25' AS tag FROM (" + LEXICAL["bm25_batch"] + ")",
    "hybrid_plan": f"{_TOPS}, s AS (SELECT query_id, doc_id, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS score FROM y WHERE method <> 'likelihood' GROUP BY query_id, doc_id) SELECT query_id, doc_id, score, rank FROM (SELECT * REPLACE (round(score, 6) AS score), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5",
}
