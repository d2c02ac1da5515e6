"""Indexes: recall floors, exactness where it is promised, quantizers, factory, tuning, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators import dense
from querent.operators.ann import buckets, density, factory, graphs, quantize
from querent.operators.components import components
from querent.operators.evaluation import neighbour_recall
from querent.queries import ann
from querent.sources import benchmarks
from querent.streaming import online


@pytest.fixture(scope="module")
def data(spark):
    vectors = benchmarks.synthetic(spark, 1000, 32).cache()
    queries = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding").cache()
    return vectors, queries, dense.search_blocks(vectors, queries, 10).cache()


def recall(truth, found):
    return neighbour_recall(truth, found, 10).agg(F.avg("recall")).first()[0]


@pytest.mark.parametrize("name", list(ann.INDEXES))
def test_recall(data, name):
    vectors, queries, truth = data
    found = ann.INDEXES[name]().build(vectors).search(queries, 10)
    assert recall(truth, found) >= 0.9
    best = found.filter("rank = 1").collect()
    assert sum(r["query_id"] == r["doc_id"] for r in best) >= 0.95 * len(best)


@pytest.mark.parametrize("make", [lambda: quantize.ProductQuantizer(32, 8, 32), lambda: quantize.OptimizedProductQuantizer(32, 8, 32), lambda: quantize.TurboQuantizer(32, 6), lambda: quantize.SaqQuantizer(32, 8, 48)])
def test_quantizers(data, make):
    vectors, queries, truth = data
    found = quantize.search_reranked(vectors, queries, quantize.fitted(vectors, make()), 10, 300)
    assert neighbour_recall(truth, found, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_quantizer_parameters():
    with pytest.raises(InvalidParameter):
        quantize.ProductQuantizer(10, 3)
    x = np.random.default_rng(0).standard_normal((300, 16))
    q = quantize.OnlineProductQuantizer(16, 4, 16).initialize(x[:100])
    before = [c.copy() for c in q.codebooks]
    q.update_batch(x[100:])
    assert any((a != b).any() for a, b in zip(before, q.codebooks, strict=True))
    t = quantize.TurboQuantizer(16, 8).fit(x)
    assert np.abs(t.decode(t.quantize(x)) - x).max() < 0.2


@pytest.mark.parametrize("text", ["HNSW16", "HNSW16,32", "NSW8", "IVF4,PQ8", "IVF4,PQ8x10", "SCANN4"])
def test_factory(text):
    assert factory.index_factory(32, text)


@pytest.mark.parametrize("text", ["", "HNSW", "HNSW0", "IVF4", "IVF4,PQ5", "IVF4,PQ8x17", "SCANN-1", "FLAT"])
def test_factory_refuses(text):
    with pytest.raises(InvalidParameter):
        factory.index_factory(32, text)


def test_tuning(data):
    vectors, queries, _ = data
    found = factory.Tuner(factory.Criterion(least=0.9)).nprobe(vectors, queries, 8, [1, 4, 8])
    assert found.recall >= 0.9 and found.parameter in (4, 8)


def rows_of(df):
    return df.orderBy("query_id", "rank").collect()


@pytest.mark.parametrize("kind", [graphs.DiskAnn, graphs.Hnsw])
def test_saved_graph(spark, data, tmp_path, kind):
    vectors, queries, _ = data
    index = kind(degree=16, ef=50).build(vectors)
    index.save(f"file://{tmp_path}/graph")
    again = kind.load(spark, f"file://{tmp_path}/graph", degree=16, ef=50)
    assert rows_of(again.search(queries, 5)) == rows_of(index.search(queries, 5))
    assert index.edges().count() > 1000 and index.stats().num_vectors == 1000


@pytest.fixture(scope="module")
def clustered(spark):
    """10,000 vectors about 200 centres, and 50 queries."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((200, 32))
    x = centres[np.arange(10_000) % 200] + 0.6 * rng.standard_normal((10_000, 32))
    vectors = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "doc_id long, embedding array<double>, kind int").cache()
    queries = vectors.filter("doc_id % 200 = 7").select(F.col("doc_id").alias("query_id"), "embedding").cache()
    return vectors, queries, dense.search_blocks(vectors, queries, 10).cache()


def test_graph_compares_few(clustered):
    """Queries go to few shards and meet few of their rows, and still find nearly all neighbours."""
    vectors, queries, truth = clustered
    index = graphs.Hnsw(degree=12, candidates=64, ef=64, shard_rows=1000, probes=3).build(vectors)
    assert index.shards.count() >= 10 and index.edges().filter("layer > 0").count() > 0
    assert recall(truth, index.search(queries, 10)) >= 0.9
    assert index.compared(queries, 10).agg(F.avg("compared")).first()[0] < 0.2 * 10_000


def test_buckets_compare_few(clustered):
    """Inverted files probe a fifteenth of the clusters."""
    vectors, queries, truth = clustered
    for index in (buckets.Ivf(clusters=60, nprobe=4), buckets.IvfPq(clusters=60, nprobe=4, books=8, bits=6, reorder=20), buckets.Scann(clusters=60, nprobe=4)):
        assert recall(truth, index.build(vectors).search(queries, 10)) >= 0.85


def test_graph_grows(data):
    """Rows that are added later are found, and shards without new rows stay."""
    vectors, queries, truth = data
    index = graphs.Hnsw(degree=16, ef=100, shard_rows=300, probes=8).build(vectors.filter("doc_id < 800"))
    before = index.shards.count()
    index.add(vectors.filter("doc_id >= 800"))
    assert index.stats().num_vectors == 1000 and index.shards.count() >= before
    assert recall(truth, index.search(queries, 10)) >= 0.9
    some = index.search_filtered(queries, F.col("doc_id") >= 900, 5)
    assert some.filter("doc_id < 900").count() == 0 and some.count() == 5 * queries.count()


def test_filtered_graph(clustered):
    """Filters that leave many rows are walked, those that leave few are compared all."""
    vectors, queries, _ = clustered
    index = graphs.Hnsw(degree=12, candidates=64, ef=80, shard_rows=2000, category="kind").build(vectors.filter("doc_id < 4000"))
    for where, least in ((F.col("kind") == 2, 0.85), (F.col("doc_id") < 40, 1.0), (F.col("kind") > 9, None)):
        truth = dense.search_blocks(vectors.filter("doc_id < 4000").filter(where).select("doc_id", "embedding"), queries, 10)
        found = index.search_filtered(queries, where, 10)
        assert found.count() == 0 if least is None else recall(truth, found) >= least
    truth = dense.search_blocks(vectors.filter("doc_id < 4000 AND kind = 2").select("doc_id", "embedding"), queries, 10)
    found = index.search_category(queries, 2, 10)
    assert recall(truth, found) >= 0.85 and found.filter("doc_id % 5 <> 2").count() == 0


def test_filtered_graph_is_exact(clustered):
    """With ``exact`` no nearest row that matches is missed, and equal vectors go by id, over several shards."""
    vectors, queries, _ = clustered
    near = vectors.filter("doc_id < 3000")
    twice = near.unionByName(near.withColumn("doc_id", F.col("doc_id") + 10_000))
    index = graphs.Hnsw(degree=4, candidates=8, ef=10, shard_rows=2000, exact=True).build(twice)
    truth = dense.search_blocks(twice.filter("kind = 2").select("doc_id", "embedding"), queries, 5)
    assert rows_of(index.search_filtered(queries, F.col("kind") == 2, 5)) == rows_of(truth)


def test_category_graph_is_exact(clustered):
    vectors, queries, _ = clustered
    near = vectors.filter("doc_id < 3000")
    twice = near.unionByName(near.withColumn("doc_id", F.col("doc_id") + 10_000))
    index = graphs.Hnsw(degree=4, candidates=8, ef=10, shard_rows=2000, category="kind", exact=True).build(twice)
    truth = dense.search_blocks(twice.filter("kind = 2").select("doc_id", "embedding"), queries, 5)
    assert rows_of(index.search_category(queries, 2, 5)) == rows_of(truth)


def test_stored_codes(spark, data, tmp_path):
    vectors, queries, truth = data
    index = buckets.IvfPq(clusters=8, nprobe=8, books=8, bits=6, reorder=30).build(vectors)
    assert recall(truth, index.search(queries, 10)) >= 0.9
    index.save(f"file://{tmp_path}/ivf")
    again = buckets.IvfPq.load(spark, f"file://{tmp_path}/ivf", clusters=8, nprobe=8, bits=6, reorder=30)
    assert rows_of(again.search(queries, 10)) == rows_of(index.search(queries, 10))
    few = index.with_categories(vectors.select("doc_id", (F.col("doc_id") % 3).alias("category"))).search_category(queries, 1, 5)
    assert few.filter("doc_id % 3 <> 1").count() == 0 and few.count() == 5 * queries.count()


def test_anisotropic_codes():
    """Errors along the vector are smaller than those of plain codes."""
    x = np.random.default_rng(3).standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, other = (q(16, 4, 8).fit(x) for q in (quantize.ProductQuantizer, quantize.AnisotropicQuantizer))
    along = [np.abs(((q.decode(q.quantize(x)) - x) * x).sum(axis=1)).mean() for q in (plain, other)]
    assert along[1] < 0.7 * along[0]


def test_tree_descent_in_batches(data):
    """The beam's first leaf is the one that a single path reaches, where that is best at each level."""
    vectors, queries, truth = data
    wide = buckets.KMeansTree(branching=8, leaf=50, beam=1000).build(vectors)
    assert recall(truth, wide.search(queries, 10)) == 1.0


def test_mock_embeddings(spark):
    from querent.functions.text import mock_embedding, mock_token_embeddings

    rows = spark.createDataFrame([("ab c",), (None,)], "text string").select(mock_embedding("text", 4).alias("e"), mock_token_embeddings("text", 4).alias("t")).collect()
    assert np.linalg.norm(rows[0]["e"]) == pytest.approx(1.0) and len(rows[0]["t"]) == 2 and rows[1]["e"] == [0.0] * 4


def test_sng_rules(data):
    order, far = np.array([3, 1, 2]), np.array([0.0, 0.5, 0.9, 0.1])
    assert graphs.martingale_prune(order, far, 0.6, 5).tolist() == [3, 1] and graphs.martingale_prune(order, far, 2.0, 1).tolist() == [3]
    shard = graphs.Sng(shard_rows=2000).build(data[0]).shards.first()
    assert shard["mean"] >= 200
    evolution = graphs.CandidateEvolution().update(10).update(20)
    assert evolution.mean == 11.0 and evolution.variance == pytest.approx(10.0)
    assert graphs.truncation(10**6, 64) > 2.0 and graphs.max_degree(8, 1.0) == 16 and graphs.max_degree(10**6, 2.0) == 256


def test_clusters_and_duplicates(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4, 24)
    rows = [(i, (centres[i % 4] + 0.01 * rng.standard_normal(24)).tolist()) for i in range(80)] + [(80, centres[0].tolist()), (81, centres[0].tolist()), (82, None)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    found = density.Layers(dimension=12, least=5).fit_predict(vectors).collect()
    assert len({r["cluster"] for r in found if r["doc_id"] < 80}) == 4
    assert {(r["doc_id"], r["group"]) for r in density.duplicates(vectors).collect()} == {(80, 80), (81, 80)}
    near = np.repeat(rng.standard_normal((40, 24)), 3, axis=0) * rng.uniform(0.5, 2, (120, 1)) + 1e-3 * rng.standard_normal((120, 24))
    x = near / np.linalg.norm(near, axis=1, keepdims=True)
    got = {(r["doc_id"], r["group"]) for r in density.duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "doc_id long, embedding array<double>"), 2e-6).collect()}
    close = (x @ x.T >= 1 - 2e-6) & ~np.eye(120, dtype=bool)
    assert {i for i, _ in got} == set(np.nonzero(close.any(axis=1))[0].tolist()) and 0 < len(got) < 120
    with pytest.raises(InvalidParameter):
        density.projection(4, 4)
    layers = density.Layers(dimension=12, least=5, thresholds=(0.9, 0.0)).fit(vectors).cache()
    tree = density.merge_tree(layers).collect()
    assert len([r for r in tree if r["threshold"] == 0.9]) == 4 and all(r["parent"] is not None for r in tree if r["threshold"] == 0.9)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 200), (7, 7), (300, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[500] == got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skewed_bucket_is_dealt(spark, data):
    vectors, queries, truth = data
    one = vectors.withColumn("bucket", F.lit(1).cast("long")).select("doc_id", "embedding", "bucket")
    found = buckets.bucket_search(one, queries.withColumn("bucket", F.lit(1).cast("long")), 10, task_rows=100)
    assert found.select("query_id", "doc_id", "rank").exceptAll(truth.select("query_id", "doc_id", "rank")).count() == 0


def test_streams(spark, data, tmp_path):
    from querent.sources.storage import SegmentStore

    vectors, _, _ = data
    vectors.write.parquet(f"{tmp_path}/v")
    q = quantize.OnlineProductQuantizer(32, 4, 16)
    online.follow(spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/v"), q, f"{tmp_path}/c1", per_step=300).awaitTermination()
    assert q.counts is not None and q.counts[0].sum() > 600  # every vector counts, though earlier ones fade
    docs = spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    for _ in range(2):  # the second start finds nothing new
        online.ingest(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/d"), store, f"{tmp_path}/c2").awaitTermination()
    assert {(r["term"], r["df"]) for r in store.terms().collect()} == {("one", 1), ("two", 2)} and store.inconsistent().count() == 0


def test_runner(spark):
    train, test = benchmarks.split(benchmarks.synthetic(spark, 300, 8), 300)
    runner = benchmarks.Runner(train, test, ks=(1, 10))
    runner.run("exact", buckets.ExactTree())
    assert [r["best_recall"] for r in benchmarks.summary(runner.frame(spark)).collect()] == [1.0]
    assert [(r["k"], r["exact"]) for r in benchmarks.by_k(runner.frame(spark)).collect()] == [(1, 1.0), (10, 1.0)]
    assert benchmarks.plot(runner.frame(spark), 10).startswith("exact ####")
