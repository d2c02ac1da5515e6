"""Bucket indexes: inverted files, sign-bit hashing, random-hyperplane forests, cluster trees, and exact trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter
from querent.operators import dense
from querent.operators.ann import kmeans
from querent.operators.ann.base import AnnStats, bucket_search, sample, with_buckets
from querent.runtime import materialize


class _Buckets:
    """An index whose rows lie in one or more buckets each; a stored table clustered by bucket."""

    rows: DataFrame | None = None

    def _store(self, vectors: DataFrame, assign) -> None:
        self.rows = materialize(with_buckets(vectors, "doc_id", assign).repartitionByRange("bucket").sortWithinPartitions("bucket"), "ann")
        self._probe = assign

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bucket_search(self.rows, with_buckets(queries, "query_id", self._probe), k)

    def stats(self) -> AnnStats:
        row = self.rows.agg(F.countDistinct("doc_id"), F.max(F.size("embedding")), F.sum(F.size("embedding") * 4 + 16)).first()
        return AnnStats(int(row[0]), int(row[1] or 0), int(row[2] or 0))


@dataclass
class Ivf(_Buckets):
    """Inverted file over k-means clusters; a query compares exactly within its ``nprobe`` nearest clusters."""

    clusters: int = 1024
    nprobe: int = 100
    seed: int = 0
    centroids: np.ndarray | None = field(default=None, repr=False)
    masks: DataFrame | None = field(default=None, repr=False)

    def build(self, vectors: DataFrame) -> Ivf:
        self.centroids = kmeans.fit(vectors, self.clusters, seed=self.seed)
        c = self.centroids
        self._store(vectors, lambda x: (x @ c.T).argmax(axis=1)[:, None])
        self._ask()
        return self

    def save(self, path: str) -> None:
        """Rows clustered by bucket, and the centroids."""
        self.rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "doc_id").write.parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "bucket int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str, **options):
        """A stored index, with the options that its searches are to use."""
        index = cls(**options)
        index.rows = spark.read.parquet(f"{path}/rows")
        index.centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("bucket").collect()])  # ``clusters`` rows
        index._ask()
        return index

    def _ask(self) -> None:
        c, n = self.centroids, max(1, min(self.nprobe, len(self.centroids)))
        self._probe = lambda x: np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]

    def with_categories(self, metadata: DataFrame) -> Ivf:
        """Categories (doc_id, category in 0..63) for ``search_category``: each cluster gets a bit mask of its categories."""
        self.rows = materialize(self.rows.join(metadata.select("doc_id", "category"), "doc_id", "left"), "ann")
        self.masks = materialize(self.rows.filter("category >= 0 AND category < 64").groupBy("bucket").agg(F.bit_or(F.expr("shiftleft(1L, category)")).alias("mask")), "ann")
        return self

    def search_category(self, queries: DataFrame, category: int, k: int = 10) -> DataFrame:
        """As ``search``, among rows of the category; clusters without it are skipped by their masks."""
        return bucket_search(self._of_category(category), with_buckets(queries, "query_id", self._probe), k)

    def _of_category(self, category: int) -> DataFrame:
        if self.masks is None:
            raise InvalidParameter("the index has no categories")
        if not 0 <= category < 64:
            raise InvalidParameter("categories are 0 to 63")
        bit = 1 << category if category < 63 else -(1 << 63)
        some = self.masks.filter(F.col("mask").bitwiseAND(F.lit(bit)) != 0).select("bucket")
        return self.rows.filter(F.col("category") == category).join(some, "bucket", "left_semi").select("doc_id", "embedding", "bucket")


@dataclass
class IvfPq(Ivf):
    """An inverted file of product codes: a query compares its table of products with the codes in its ``nprobe`` nearest
    clusters, and the ``reorder`` * k best are rescored by the vectors, which are read for these alone."""

    books: int = 8
    bits: int = 8
    reorder: int = 10
    quantizer: object | None = field(default=None, repr=False)
    vectors: DataFrame | None = field(default=None, repr=False)

    def _quantizer(self, dim: int):
        from querent.operators.ann.quantize import ProductQuantizer

        return ProductQuantizer(dim, self.books, 1 << self.bits)

    def build(self, vectors: DataFrame) -> IvfPq:
        from querent.operators.ann.quantize import encode, fitted

        super().build(vectors)
        self.quantizer = fitted(vectors, self._quantizer(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1))
        self.vectors = materialize(self.rows.select("doc_id", "embedding"), "ann")
        codes = encode(self.rows, self.quantizer)
        placed = self.rows.select("doc_id", "bucket").join(codes, "doc_id").select("doc_id", F.col("codes").cast("array<float>").alias("embedding"), "bucket")
        self.rows = materialize(placed.repartitionByRange("bucket").sortWithinPartitions("bucket"), "ann")
        return self

    def _rescored(self, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        from querent.operators.rerank import rerank_cosine

        quantizer = self.quantizer
        # Codes up to 16 bits went through floats, which hold them exactly.
        found = bucket_search(docs, with_buckets(queries, "query_id", self._probe), self.reorder * k, compare=lambda q, c: quantizer.similarities(q, c.astype(np.int64)))
        return rerank_cosine(found, self.vectors, queries, k).select("query_id", "doc_id", "score", "rank")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self._rescored(self.rows.select("doc_id", "embedding", "bucket"), queries, k)

    def search_category(self, queries: DataFrame, category: int, k: int = 10) -> DataFrame:
        return self._rescored(self._of_category(category), queries, k)

    def save(self, path: str) -> None:
        super().save(path)
        self.vectors.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/vectors")
        rows = [(b, i, c.tolist()) for b, book in enumerate(self.quantizer.codebooks) for i, c in enumerate(book)]
        self.rows.sparkSession.createDataFrame(rows, "book int, code int, word array<double>").coalesce(1).write.parquet(f"{path}/codebooks")

    @classmethod
    def load(cls, spark, path: str, **options):
        index = super().load(spark, path, **options)
        books: list[list] = []
        for r in spark.read.parquet(f"{path}/codebooks").orderBy("book", "code").collect():  # books * codes words
            if r["book"] == len(books):
                books.append([])
            books[-1].append(r["word"])
        index.books, index.vectors = len(books), spark.read.parquet(f"{path}/vectors")
        index.quantizer = index._quantizer(index.centroids.shape[1])
        index.quantizer.codebooks = [np.array(b) for b in books]
        return index


@dataclass
class Scann(IvfPq):
    """An inverted file of anisotropic codes, the first max(reorder, k) of which are rescored; a tenth of the partitions, 1 to
    10, are probed."""

    clusters: int = 256
    nprobe: int = 0
    books: int = 0
    bits: int = 4
    reorder: int = 100

    def _quantizer(self, dim: int):
        from querent.operators.ann.quantize import AnisotropicQuantizer

        books = self.books or max(b for b in range(1, dim + 1) if dim % b == 0 and b <= max(1, dim // 2))
        return AnisotropicQuantizer(dim, books, 1 << self.bits)

    def _ask(self) -> None:
        self.nprobe = self.nprobe or min(10, max(1, self.clusters // 10))
        super()._ask()

    def _rescored(self, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        from querent.operators.rerank import rerank_cosine

        quantizer = self.quantizer
        found = bucket_search(docs, with_buckets(queries, "query_id", self._probe), max(self.reorder, k), compare=lambda q, c: quantizer.similarities(q, c.astype(np.int64)))
        return rerank_cosine(found, self.vectors, queries, k).select("query_id", "doc_id", "score", "rank")


@dataclass
class Lsh(_Buckets):
    """Tables of sign bits of random projections; rows that share a whole signature in a table are compared."""

    tables: int = 10
    functions: int = 10
    seed: int = 0

    def build(self, vectors: DataFrame) -> Lsh:
        dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
        planes = np.random.default_rng(self.seed).standard_normal((self.tables, self.functions, dim))
        weights, first = 1 << np.arange(self.functions), np.arange(self.tables) << self.functions

        def assign(x: np.ndarray) -> np.ndarray:
            return (np.einsum("nd,tfd->ntf", x, planes) > 0) @ weights + first

        self._store(vectors, assign)
        return self


@dataclass
class Annoy(_Buckets):
    """A forest: each tree splits a sample at medians along random directions until leaves are small; all rows go to leaves."""

    trees: int = 10
    leaf: int = 64
    seed: int = 0

    def build(self, vectors: DataFrame) -> Annoy:
        x = sample(vectors, seed=self.seed)
        total = vectors.count()
        least = max(2, int(self.leaf * len(x) / max(1, total)))  # a leaf of all rows holds about ``leaf``
        rng = np.random.default_rng(self.seed)
        forest, leaf = [self._grow(x, least, rng) for _ in range(self.trees)], self._leaf

        def assign(v: np.ndarray) -> np.ndarray:
            return np.stack([(t << 40) + leaf(tree, v) for t, tree in enumerate(forest)], axis=1)

        self._store(vectors, assign)
        return self

    @staticmethod
    def _grow(x: np.ndarray, least: int, rng) -> list:
        """Nodes (direction, cut, left, right); a leaf has no direction."""
        nodes, todo = [None], [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            if len(rows) <= least or depth >= 30:
                continue
            a, b = x[rng.choice(rows, 2, replace=False)]
            way = a - b if np.abs(a - b).max() > 1e-12 else rng.standard_normal(x.shape[1])
            value = x[rows] @ way
            cut = float(np.median(value))
            left = value < cut
            if left.all() or not left.any():
                continue
            nodes[at] = (way, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
            nodes += [None, None]
        return nodes

    @staticmethod
    def _leaf(nodes: list, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if nodes[at] is None:
                out[rows] = at
                continue
            way, cut, left, right = nodes[at]
            below = x[rows] @ way < cut
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


@dataclass
class KMeansTree(_Buckets):
    """A tree of k-means splits fitted on a sample; a query follows the ``beam`` nearest children at each level."""

    branching: int = 16
    leaf: int = 50
    depth: int = 10
    beam: int = 4
    seed: int = 0

    def build(self, vectors: DataFrame) -> KMeansTree:
        x, total = sample(vectors, seed=self.seed), vectors.count()
        least = max(2, int(self.leaf * len(x) / max(1, total)))
        children: dict[int, tuple[np.ndarray, list[int]]] = {}
        todo, free = [(0, np.arange(len(x)), 0)], 1
        while todo:
            at, rows, depth = todo.pop()
            if len(rows) <= max(least, self.branching) or depth >= self.depth:
                continue
            c = kmeans.lloyd(x[rows], self.branching, 10, self.seed)
            label = (x[rows] @ c.T).argmax(axis=1)
            kept = [i for i in range(len(c)) if (label == i).any()]  # empty clusters get no child
            if len(kept) < 2:
                continue
            children[at] = (c[kept], list(range(free, free + len(kept))))
            todo += [(free + j, rows[label == i], depth + 1) for j, i in enumerate(kept)]
            free += len(kept)

        def descend(v: np.ndarray, beam: int) -> np.ndarray:
            """The leaves that each row reaches, level by level for all rows at a time."""
            nodes, scores = np.full((len(v), beam), -1, np.int64), np.full((len(v), beam), -np.inf)
            nodes[:, 0] = scores[:, 0] = 0
            while any(int(node) in children for node in np.unique(nodes)):
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for node in np.unique(nodes[nodes >= 0]).tolist():
                    row, at = np.nonzero(nodes == node)
                    if node in children:
                        c, ids = children[node]
                        found.append((np.repeat(row, len(c)), (v[row] @ c.T).ravel(), np.tile(ids, len(row))))
                    else:
                        found.append((row, scores[row, at], np.full(len(row), node)))
                row, score, node = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((node, -score, row))
                row, score, node = row[order], score[order], node[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                first = place < beam
                nodes, scores = np.full((len(v), beam), -1, np.int64), np.full((len(v), beam), -np.inf)
                nodes[row[first], place[first]], scores[row[first], place[first]] = node[first], score[first]
            return nodes

        beam = self.beam
        self._store(vectors, lambda v: descend(v, 1))
        self._probe = lambda v: descend(v, beam)
        return self


@dataclass
class ExactTree:
    """KD, ball and random-projection trees: their searches visit every leaf, so results are exact neighbours.

    Blocks of vectors play the leaves' part; ``kind`` and its limits are kept for callers.
    """

    kind: str = "kd"
    leaf: int = 10
    depth: int = 32
    vectors: DataFrame | None = field(default=None, repr=False)

    def build(self, vectors: DataFrame) -> ExactTree:
        if self.kind not in ("kd", "ball", "rp"):
            raise InvalidParameter(f"unknown tree {self.kind}")
        self.vectors = vectors.select("doc_id", "embedding")
        return self

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return dense.search_blocks(self.vectors, queries, k)
