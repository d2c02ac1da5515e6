"""Hand-made collections with known answers, edge cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.errors import DimensionMismatch, EmptyIndex, EmptyQuery, InvalidParameter, RetrievalError
from querent.functions import vectors as V
from querent.operators import dense, evaluation, expansion, filters, fusion, generative, rerank, routing, sparse
from querent.operators.lexical import Bm25Params, EagerIndex, LexicalIndex, Smoothing, TfIdfParams, query_terms
from querent.plans.pipeline import Plan
from querent.sources import backends, codecs, storage, trec

#: 11 words in 6 documents: amber in 0 (twice) and 2, lantern in 0 and 1, harbour in 1 and 4.
DOCS = [(0, "Amber lantern, amber"), (1, "lantern harbour"), (2, "amber"), (3, "granite quarry dust"), (4, "harbour ferry"), (5, "")]


@pytest.fixture(scope="module")
def index(spark):
    return LexicalIndex.from_texts(spark.createDataFrame(DOCS, "doc_id long, text string"))


def ids(df):
    return [r["doc_id"] for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_known(spark, index):
    found = index.bm25(query_terms(spark, {1: "amber", 2: "harbour lantern", 3: "absent"}), 10).collect()
    idf = math.log((6 - 2 + 0.5) / (2 + 0.5) + 1)
    part = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * 6 / 11))
    want = {(1, 0): part(2, 3), (1, 2): part(1, 1), (2, 0): part(1, 3), (2, 1): 2 * part(1, 2), (2, 4): part(1, 2)}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in found} == pytest.approx(want, abs=1e-6)
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 2] == [1, 4, 0]
    assert ids(index.bm25(query_terms(spark, {1: "harbour lantern"}), 1)) == [1]
    assert ids(index.bm25(query_terms(spark, {1: "amber"}), 0)) == []


def test_empty_queries_and_parameters(spark, index):
    with pytest.raises(EmptyQuery):
        query_terms(spark, {1: "!!"})
    with pytest.raises(InvalidParameter):
        index.bm25(query_terms(spark, {1: "amber"}), -1)
    with pytest.raises(InvalidParameter):
        _ = Bm25Params(variant="x").added


def test_null_texts_and_empty_index(spark):
    index = LexicalIndex.from_texts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert index.totals == (2, 0)
    assert index.bm25(query_terms(spark, {1: "a"}), 5).count() == 0
    none = LexicalIndex.from_texts(spark.createDataFrame([], "doc_id long, text string"))
    assert none.average_length == 0.0 and none.bm25(query_terms(spark, {1: "a"}), 5).count() == 0


def test_topk_is_a_prefix_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "common term" if i % 2 else "common") for i in range(50)], "doc_id long, text string")
    index = LexicalIndex.from_texts(docs)
    asked = query_terms(spark, {1: "common"})
    long, short = ids(index.bm25(asked, 20)), ids(index.bm25(asked, 7))
    assert long[:7] == short == [0, 2, 4, 6, 8, 10, 12]


def test_variants_saturation_and_repeats(spark):
    docs = spark.createDataFrame([(1, "test"), (2, " ".join(["test"] * 5)), (3, " ".join(["test"] * 20)), (4, "other")], "doc_id long, text string")
    index = LexicalIndex.from_texts(docs)
    once = {r["doc_id"]: r["score"] for r in index.bm25(query_terms(spark, {1: "test"}), 10).collect()}
    twice = {r["doc_id"]: r["score"] for r in index.bm25(query_terms(spark, {1: "test test"}), 10).collect()}
    plus = {r["doc_id"]: r["score"] for r in index.bm25(query_terms(spark, {1: "test"}), 10, Bm25Params(variant="plus")).collect()}
    for i in once:
        assert math.isclose(twice[i], 2 * once[i], abs_tol=2e-6) and plus[i] > once[i]
    linear = {r["doc_id"]: r["score"] for r in index.tfidf(query_terms(spark, {1: "test"}), 10, TfIdfParams("linear")).collect()}
    logs = {r["doc_id"]: r["score"] for r in index.tfidf(query_terms(spark, {1: "test"}), 10).collect()}
    assert linear[3] > logs[3] and math.isclose(linear[1], logs[1], abs_tol=1e-6)


def test_eager_equals_lazy_and_manual(spark, index):
    asked = query_terms(spark, {1: "amber lantern", 2: "ferry harbour dust"})
    for params in (Bm25Params(), Bm25Params(variant="l")):
        lazy = index.bm25(asked, 10, params).orderBy("query_id", "rank").collect()
        assert index.eager(params).retrieve(asked, 10).orderBy("query_id", "rank").collect() == lazy
    given = EagerIndex(spark.createDataFrame([("tar", 4, 1.25), ("rope", 4, 0.5), ("tar", 9, 2.0), ("sail", 6, 8.0)], "term string, doc_id long, score double"))
    found = given.retrieve(query_terms(spark, {1: "rope tar hull"}), 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(9, 2.0), (4, 1.75)]


def test_likelihood_fallback_and_extremes(spark, index):
    assert ids(index.query_likelihood(query_terms(spark, {1: "unseen"}), 10)) == [0, 1, 2, 3, 4, 5]
    for s in (Smoothing.jelinek_mercer(0.0), Smoothing.jelinek_mercer(2.0), Smoothing.dirichlet(-1.0)):
        assert ids(index.query_likelihood(query_terms(spark, {1: "quarry"}), 10, s)) == [3]


def test_dense(spark):
    rows = spark.createDataFrame([(0, [2.0, 1.0, 0.0], 5), (1, [0.0, 3.0, 1.0], 6), (2, [-1.0, 0.0, 2.0], 5), (3, [0.5, 0.0, 4.0], 6)], "doc_id long, embedding array<float>, category int")
    found = dense.retrieve(rows, {7: [1.0, 1.0, 0.0]}, 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(0, 3.0), (1, 3.0), (3, 0.5)]  # negative products are left out
    assert ids(dense.retrieve(rows, {7: [1.0, 1.0, 0.0]}, 1, filters.equals("category", 6))) == [1]
    with pytest.raises(RetrievalError):
        dense.retrieve(rows, {7: [1.0, 1.0, 0.0]}, 2, filters.equals("category", 5), strict=True)
    asked = spark.createDataFrame([(7, [1.0, 1.0, 0.0])], "query_id long, embedding array<float>")
    best = dense.search_blocks(rows, asked, 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(0, round(3 / math.sqrt(10), 6)), (1, round(3 / math.sqrt(20), 6))]
    bad = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match=DimensionMismatch.__name__):
        dense.search_blocks(rows, bad, 2).collect()


def test_vector_scalars(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    out = row.select(V.dot("a", "b").alias("d"), V.norm("a").alias("n"), V.cosine("a", "z").alias("c"), V.l2("a", "b").alias("l"), V.l2("a", "z").alias("m"), V.inner_product_distance("a", "a").alias("i")).first()
    assert out["d"] == 11.0 and out["n"] == 5.0 and out["c"] == 0.0 and math.isinf(out["l"]) and out["m"] == 5.0 and out["i"] == -25.0


def test_sparse(spark):
    rows = spark.createDataFrame([(0, [0, 1, 2], [1.0, 0.5, 0.3]), (1, [1, 2, 3], [0.8, 0.6, 0.4])], "doc_id long, indices array<int>, values array<double>")
    asked = sparse.exploded(spark.createDataFrame([(1, [0, 1], [1.0, 1.0])], "query_id long, indices array<int>, values array<double>"), "query_id")
    found = sparse.retrieve(sparse.exploded(rows), asked, 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(0, 1.5), (1, 0.8)]
    one = spark.createDataFrame([([1, 2, 3, 4], [0.1, 0.9, -0.3, 0.8], [3, 3], [3.0, 4.0])], "i array<int>, v array<double>, x array<int>, y array<double>")
    out = one.select(sparse.prune("i", "v", 0.5).alias("p"), sparse.top("i", "v", 2).alias("t"), sparse.is_valid("i", "v").alias("g"), sparse.is_valid("x", "y").alias("b"), sparse.norm("y").alias("n"), sparse.normalize("x", "y").alias("u")).first()
    assert out["p"]["indices"] == [2, 4] and out["t"]["indices"] == [2, 4] and out["g"] and not out["b"] and out["n"] == 5.0
    assert out["u"]["values"] == [0.6, 0.8]


def test_filters(spark):
    rows = spark.createDataFrame([(i, 1 if i < 10 else 2, None if i == 3 else i % 2) for i in range(15)], "doc_id long, category int, region int")
    assert [tuple(r) for r in filters.facet_counts(rows, "category").collect()] == [(1, 10), (2, 5)]
    assert rows.filter(filters.all_of()).count() == 15 and rows.filter(filters.any_of()).count() == 0
    assert rows.filter(~filters.equals("region", 0)).count() == 7  # a missing field doesn't match
    assert filters.selectivity(rows, filters.equals("category", 2)).first()[0] == pytest.approx(1 / 3)
    e = spark.createDataFrame([([0.1, 0.2, 0.3], 1)], "e array<double>, c int")
    assert e.select(filters.augment("e", F.col("c"), 3, 10.0)).first()[0] == [0.1, 0.2, 0.3, 0.0, 10.0, 0.0]
    with pytest.raises(Exception, match="out of range"):
        e.select(filters.augment("e", F.col("c") + 5, 3, 10.0)).collect()


def _list(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_fusion(spark):
    lists = {"a": _list(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2)]), "b": _list(spark, [(1, 11, 9.0, 1), (1, 12, 9.0, 2)])}
    for method in (fusion.rrf, fusion.isr, fusion.borda, fusion.combsum, fusion.combmnz, fusion.dbsf):
        found = method(lists).orderBy("rank").collect()
        assert {r["doc_id"] for r in found} == {10, 11, 12} and all(math.isfinite(r["score"]) and r["score"] >= 0 for r in found)
        assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert fusion.rrf(lists).orderBy("rank").first()["doc_id"] == 11
    assert fusion.weighted(lists, {"a": 1.0}).orderBy("rank").first()["doc_id"] == 10
    with pytest.raises(InvalidParameter):
        fusion.rrf({})


def test_rerank(spark):
    tokens = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.5, 0.0]])], "doc_id long, tokens array<array<double>>")
    asked = spark.createDataFrame([(9, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, tokens array<array<double>>")
    found = rerank.rank_maxsim(asked, tokens).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(1, 2.0), (2, 0.5)]
    both = tokens.crossJoin(asked.select(F.col("tokens").alias("q"))).filter("doc_id = 1")
    assert [tuple(a) for a in both.select(rerank.alignments("q", "tokens")).first()[0]] == [(0, 0, 1.0), (1, 1, 1.0)]
    assert both.select(rerank.highlight("q", "tokens", 0.9)).first()[0] == [0, 1]
    eight = spark.createDataFrame([(1, [[float(i), 1.0] for i in range(8)])], "doc_id long, tokens array<array<double>>")
    for factor, n in ((1, 8), (2, 4), (3, 3), (4, 2)):
        assert len(eight.select(rerank.pool_tokens("tokens", factor)).first()[0]) == n
    assert len(rerank.pool_tokens_clustered(eight, 3).first()["tokens"]) == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    picked = rerank.diversify(_list(spark, [(1, 1, 1.0, 1), (1, 2, 0.99, 2), (1, 3, 0.6, 3)]), vectors, 2)
    assert ids(picked) == [1, 3]


def test_evaluation(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 12, 1), (2, 5, 1)], "query_id long, doc_id long, rel int")
    by = {r["query_id"]: r for r in evaluation.binary_metrics(run, qrels, 4).collect()}
    assert by[1]["precision"] == 0.5 and by[1]["recall"] == 1.0 and by[1]["reciprocal_rank"] == 1.0
    assert by[1]["average_precision"] == pytest.approx((1 + 2 / 3) / 2) and by[2]["recall"] == 0.0
    graded = {r["query_id"]: r for r in evaluation.graded_metrics(run, qrels, 10).collect()}
    assert graded[1]["err"] == pytest.approx(1 / 4 + 3 / 4 * 3 / 4 / 3) and 0 < graded[1]["ndcg"] < 1
    stats = evaluation.statistics(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double"), "v").first()
    assert (stats["p50"], stats["p95"], stats["mean"]) == (3.0, 4.0, 2.5)  # round(0.5 * 3) = 2: the third


def test_expansion_and_routing(spark, index):
    asked = query_terms(spark, {1: "granite"})
    terms = expansion.expansion_terms(index, asked, index.bm25(asked, 5), expansion.Expander(terms=2))
    assert [r["term"] for r in terms.orderBy("rank").collect()] == ["dust", "quarry"]
    assert set(ids(expansion.retrieve_with_feedback(index, query_terms(spark, {1: "ferry"})))) == {1, 4}
    assert expansion.Expander(weight=7).weight == 1.0
    rows = spark.createDataFrame([(1, ["retrieval", "semantics"]), (2, ["a", "a", "a", "a"]), (3, []), (4, ["tiny", "word"])], "query_id long, terms array<string>")
    assert [r["kind"] for r in routing.routed(rows).orderBy("query_id").collect()] == ["semantic", "keyword", "unknown", "hybrid"]
    assert rows.select(routing.route("terms", enabled=False)).first()[0] == ["bm25"]


def test_generative(spark):
    passages = spark.createDataFrame([(0, "At noon the ferry leaves the old harbour"), (1, None), (2, "old harbour wall")], "doc_id long, text string")
    named = spark.createDataFrame([(1, "old harbour", 4.0), (1, "ferry leaves", 2.5), (1, "night ferry", 6.0), (1, "at", 7.0), (1, "old harbour", 1.5)], "query_id long, identifier string, weight double")
    assert [(r["doc_id"], r["score"]) for r in generative.score_passages(passages, named).orderBy("rank").collect()] == [(0, 6.5), (2, 4.0), (1, 0.0)]
    assert generative.matching_identifiers(passages, named).count() == 3
    asked = spark.createDataFrame([(1, "when does it leave")], "query_id long, text string")
    assert generative.retrieve(passages, asked, k=10).count() == 3
    rows = spark.createDataFrame([(1, 1, 10.0, True), (1, 2, 4.0, False), (2, 3, 1.0, True)], "query_id long, doc_id long, score double, relevant boolean")
    by = {r["query_id"]: r["loss1"] for r in generative.rank_losses(rows).collect()}
    assert by == {1: 494.0, 2: 0.0}


def test_codecs():
    assert codecs.gaps([5, 7, 9, 12]) == [5, 2, 2, 3] and codecs.ungap([5, 2, 2, 3]) == [5, 7, 9, 12]
    rng = np.random.default_rng(0)
    for n in (0, 1, 50):
        ids_ = sorted(set(rng.integers(0, 10_000, n).tolist()))
        assert codecs.decompress_set(codecs.compress_set(ids_, 10_000), 10_000) == ids_
        width = codecs.bit_width(ids_)
        assert codecs.unpack(codecs.pack(ids_, width), width, len(ids_)) == ids_
        symbols = rng.integers(0, 7, n).tolist()
        assert codecs.UniformCoder(7).decode(codecs.UniformCoder(7).encode(symbols)) == symbols
    for bad in ([3, 3], [5, 4], [20_000]):
        with pytest.raises(InvalidParameter):
            codecs.compress_set(bad, 10_000)
    with pytest.raises(InvalidParameter):
        codecs.decompress_set(codecs.compress_set([1, 2], 10)[:-1], 10)


def test_store(spark, tmp_path):
    rows = [(0, ["oak", "elm"]), (1, ["oak", "ash", "ash"]), (2, ["yew"]), (3, ["fir", "oak"])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    store = storage.SegmentStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(EmptyIndex):
        store.postings()
    a = store.add_segment(docs.filter("doc_id < 2"))
    b = store.add_segment(docs.filter("doc_id >= 2"))
    store.delete(a, [1])
    assert {r["doc_id"] for r in store.lengths().collect()} == {0, 2, 3} and store.inconsistent().count() == 0
    # A document that is added again lives in its new segment.
    c = store.add_segment(spark.createDataFrame([(1, ["ash", "elm"])], docs.schema))
    assert {r["doc_id"] for r in store.lengths().collect()} == {0, 1, 2, 3}
    store.checkpoint()
    assert len(store.checkpoints()) == 1 and {r["kind"] for r in store.events().collect()} == {"add_segment", "delete_documents", "checkpoint"}
    assert {(r["term"], r["df"], r["cf"]) for r in store.terms("a").collect()} == {("ash", 1, 1)}
    with pytest.raises(InvalidParameter):
        store.merge([99])
    merged = store.merge([a, c])
    assert store.live() == [b, merged] and storage.deletions(store.events()).count() == 0 and storage.open_merges(store.events()).count() == 0
    assert {(r["term"], r["doc_id"], r["tf"]) for r in store.postings().collect()} == {("oak", 0, 1), ("elm", 0, 1), ("ash", 1, 1), ("elm", 1, 1), ("yew", 2, 1), ("fir", 3, 1), ("oak", 3, 1)}
    store.append("start_merge", transaction_id=77, segment_ids=[b])
    store.delete(merged, [0])
    store.checkpoint()
    assert [r["transaction_id"] for r in storage.open_merges(store.events()).collect()] == [77] and store.duplicated().count() == 0
    gone = store.cleanup()
    assert any(p.endswith(f"segment_id={a}") for p in gone) and any("epoch=0" in p for p in gone) and len(store.checkpoints()) == 1
    again = storage.SegmentStore(spark, store.path)  # read back from the checkpoint alone
    assert again.live() == [b, merged] and {r["doc_id"] for r in again.lengths().collect()} == {1, 2, 3} and again.inconsistent().count() == 0
    assert ids(again.index().bm25(query_terms(spark, {1: "elm"}), 5)) == [1]
    whole = LexicalIndex(spark.createDataFrame([(1, ["ash", "elm"]), *rows[2:]], docs.schema))
    asked = query_terms(spark, {1: "oak elm", 2: "ash ash yew"})
    assert again.index().bm25(asked, 5).collect() == whole.bm25(asked, 5).collect()
    assert again.add_segment(docs.filter("doc_id = 0")) == merged + 1


def test_trec(spark, tmp_path):
    run = _list(spark, [(1, 10, 3.0, 1), (1, 11, 2.5, 2)])
    trec.write_run(run, f"file://{tmp_path}/run", "mine")
    back = trec.read_run(spark, f"file://{tmp_path}/run").orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["score"], r["tag"]) for r in back] == [("1", "10", 3.0, "mine"), ("1", "11", 2.5, "mine")]
    trec.write_qrels(spark.createDataFrame([(1, 10, 2)], "query_id long, doc_id long, rel int"), f"file://{tmp_path}/qrels")
    assert trec.read_qrels(spark, f"file://{tmp_path}/qrels").first()["rel"] == 2


def test_plan(spark, index):
    asked = query_terms(spark, {1: "deep learning"})
    plan = Plan().retrieve("bm25", lambda k: index.bm25(asked, k)).retrieve("tfidf", lambda k: index.tfidf(asked, k)).fuse("rrf").top(1)
    assert ids(plan.run()) == [1]
    with pytest.raises(InvalidParameter):
        Plan().run()
    with pytest.raises(InvalidParameter):
        Plan().fuse("nothing")


def test_ranks_are_exact(spark):
    """Scores that differ behind the sixth decimal are ranked apart, as in long lists fused by reciprocal ranks."""
    lists = {m: spark.range(1, 1001).select(F.lit(1).alias("query_id"), (1001 * (m == "b") + (1 - 2 * (m == "b")) * F.col("id")).cast("long").alias("doc_id"), (-F.col("id")).cast("double").alias("score"), F.col("id").alias("rank")) for m in ("a", "b")}
    want = {i: 1 / (60 + i) for i in range(1, 1001)}
    one = fusion.rrf({"a": lists["a"]}, None).collect()
    assert {r["doc_id"]: r["rank"] for r in one} == {i: i for i in want}
    both = {r["doc_id"]: r["rank"] for r in fusion.rrf(lists, None).collect()}
    order = sorted(want, key=lambda i: (-round(want[i] + want[1001 - i], 12), i))
    assert both == {i: n for n, i in enumerate(order, 1)}


def test_single_scores(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "doc_id long, terms array<string>")
    index = LexicalIndex(docs)
    asked = query_terms(spark, {7: ["a", "b"]})
    best = {r["doc_id"]: r["score"] for r in index.bm25(asked, None).collect()}
    got = {r["doc_id"]: r["score"] for r in index.bm25_score(asked, docs.filter("doc_id <> 2")).collect()}
    assert got == {1: best[1], 3: 0.0}
    rows = sparse.exploded(spark.createDataFrame([(1, [0, 4], [1.0, 2.0]), (2, [5], [3.0]), (3, [4], [9.0])], "doc_id long, indices array<int>, values array<double>"))
    one = sparse.exploded(spark.createDataFrame([(7, [4], [0.5])], "query_id long, indices array<int>, values array<double>"), "query_id")
    assert {r["doc_id"]: r["score"] for r in sparse.score(rows, one, docs.filter("doc_id < 3")).collect()} == {1: 1.0, 2: 0.0}
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 1.0])], "query_id long, embedding array<double>")
    assert {r["doc_id"]: r["score"] for r in dense.score(vectors, asked, docs.filter("doc_id < 3")).collect()} == {1: 4.0, 2: 5.0}
    for backend in (backends.DenseBackend(), backends.DenseBackend("HNSW4")):
        backend.add_documents(vectors.filter("doc_id < 3"))
        backend.build()
        assert ids(backend.retrieve(asked, 2)) == [1, 2] or ids(backend.retrieve(asked, 2)) == [2, 1]
    backend = backends.SparseBackend()
    backend.add_documents(rows)
    backend.build()
    assert ids(backend.retrieve(one, 5)) == [3, 1]


def test_odd_parameters(spark):
    """mu 0 smooths nothing; grades above the highest count as it."""
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "doc_id long, terms array<string>")
    got = {r["doc_id"]: r["score"] for r in LexicalIndex(docs).query_likelihood(query_terms(spark, {1: ["a", "b"]}), None, Smoothing.dirichlet(0)).collect()}
    assert got == {1: round(2 * math.log(0.5), 6), 2: 0.0}
    run = spark.createDataFrame([(1, 5, 1.0, 1), (1, 6, 0.5, 2)], "query_id long, doc_id long, score double, rank long")
    qrels = spark.createDataFrame([(1, 5, 4), (1, 6, 1)], "query_id long, doc_id long, rel int")
    assert evaluation.graded_metrics(run, qrels, 10, 2).first()["err"] == pytest.approx(3 / 4 + 1 / 4 * 1 / 4 / 2)


def test_scratch(spark):
    from querent.runtime import children, fresh_path, materialize, scratch, shared_dir

    kept = fresh_path(spark, "kept")
    with scratch(spark):
        assert materialize(spark.range(3), "gone").count() == 3
        inside = [n for n in children(spark, shared_dir(spark)) if n.startswith("gone-")]
        assert inside
    assert not [n for n in children(spark, shared_dir(spark)) if n.startswith("gone-")] and children(spark, kept) == []


@pytest.mark.parametrize("method", list(codecs.METHODS))
def test_set_methods(spark, method):
    write, read = codecs.METHODS[method]
    rng = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1), (5, 6), (300, 400), (200, 10**9)):
        ids_ = sorted(set(rng.integers(0, universe, n).tolist()))
        assert read(write(ids_, universe), universe) == ids_
    with pytest.raises(InvalidParameter):
        write([4, 4], 10)
    sets = spark.createDataFrame([("a", [9, 2, 2]), ("b", [])], "key string, ids array<long>")
    back = codecs.decompressed(codecs.compressed(sets, 100, method), 100, method)
    assert {(r["key"], tuple(r["ids"])) for r in back.collect()} == {("a", (2, 9)), ("b", ())}


def test_cross_encoder(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "b d")], "query_id long, text string")
    found = rerank.rerank_with(_list(spark, [(7, 1, 9.0, 1), (7, 2, 8.0, 2), (7, 3, 7.0, 3)]), docs, asked, lambda q, d: [len(set(x.split()) & set(y.split())) for x, y in zip(q, d, strict=True)])
    assert [(r["doc_id"], r["score"], r["original_score"]) for r in found.orderBy("rank").collect()] == [(2, 2.0, 8.0), (1, 1.0, 9.0), (3, 0.0, 7.0)]


def test_maxsim_blocks(spark):
    """Blocks give what the column expression gives: matrices of unequal sizes, empty ones, nulls in a token, ties; and no rows for pairs."""
    rng = np.random.default_rng(3)
    make = lambda n: [[float(round(v, 1)) for v in rng.standard_normal(3)] for _ in range(n)]
    docs = [(i, make(i % 4)) for i in range(40)] + [(40, None), (41, [[1.0, None, 2.0], [0.5, 0.5, 0.5]]), (42, [[1.0, 1.0]]), (43, [None])]
    docs = spark.createDataFrame(docs + [(i + 100, t) for i, t in docs], "doc_id long, tokens array<array<double>>")
    asked = spark.createDataFrame([(i, make(1 + i % 3)) for i in range(7)] + [(7, [])], "query_id long, tokens array<array<double>>")
    found, every = rerank.rank_maxsim(asked, docs, k=9), rerank.rank_maxsim(asked, docs, k=None).filter("rank <= 9")
    assert found.orderBy("query_id", "rank").collect() == every.orderBy("query_id", "rank").collect()
    assert "maxsim" not in found._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_blocks(spark, monkeypatch):
    """Blocks give what the join of terms gives: frequent and rare terms, repeated entries, ties, negative and missing weights, ids of text."""
    monkeypatch.setattr(sparse, "ENTRIES", 300)
    rng = np.random.default_rng(5)
    entries = [(f"d{i % 90:02}", f"t{int(t)}", float(round(w, 1))) for i, (t, w) in enumerate(zip(rng.zipf(1.3, 900) % 200, rng.standard_normal(900), strict=True))]
    entries += [("d91", "t1", None), ("d92", "t1", float("nan")), (None, "t1", 3.0), ("d93", None, 1.0)]
    rows = spark.createDataFrame(entries, "doc_id string, term_id string, weight double")
    asked = rows.filter("doc_id < 'd30'").selectExpr("int(substr(doc_id, 2)) AS query_id", "term_id", "float(weight) AS weight")
    found, every = sparse.retrieve(rows, asked, 7), sparse.retrieve(rows, asked, None).filter("rank <= 7")
    assert found.orderBy("query_id", "rank").collect() == every.orderBy("query_id", "rank").collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner, (term_id" not in plan
