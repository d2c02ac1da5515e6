"""Proximity graphs: NSW, layered HNSW, OPT-SNG, Vamana and a disk-resident one, in shards.

Vectors are dealt over shards by their nearest of some k-means centroids; a cluster larger than a shard should be is dealt over
several by a hash of ids. A shard's graph is one row: ids, vectors, levels, and the edges of each layer. A query goes to the
shards of its ``probes`` nearest centroids, where it descends the layers greedily and ends in a best-first beam; results
of shards are merged. So the index scales by shards, a query's work doesn't grow with their number, and a lost executor
costs a re-read. ``add`` builds again the shards that get rows, and no others.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.errors import DimensionMismatch, InvalidParameter
from querent.operators.ann import kmeans
from querent.operators.ann.base import AnnStats, matrix, unit
from querent.operators.topk import EXACT, ranked
from querent.runtime import materialize

SHARD_ROWS = 4096
PROBES = 8
SCHEMA = "shard long, cluster int, n int, dim int, ids binary, vectors binary, levels binary, offsets binary, edges binary, categories binary, mean double, variance double"


def thin(distances: np.ndarray, between: np.ndarray, order: np.ndarray, most: int, rule: str = "rnd", alpha: float = 1.3, angle: float = 60.0) -> list[int]:
    """Which of the candidates ``order`` (nearest first) to keep: positions into it.

    rnd: nearer to the node than to every kept one; rrnd: the same with the latter distance times alpha; mond: the angle
    at the node to every kept one is at least ``angle`` degrees; none: the nearest. ``between`` holds cosine distances.
    """
    if rule == "none":
        return list(range(min(most, len(order))))
    kept: list[int] = []
    limit = math.cos(math.radians(angle))
    for i, c in enumerate(order):
        if len(kept) >= most:
            break
        others = between[c, order[kept]] if kept else np.zeros(0)
        if rule == "rnd":
            good = (distances[c] < others).all()
        elif rule == "rrnd":
            good = (distances[c] < alpha * others).all()
        elif rule == "mond":
            # In the triangle of node, candidate and kept one, with squared chord lengths 2 * distance.
            a, b, x = 2 * distances[c], 2 * distances[order[kept]] if kept else np.zeros(0), 2 * others
            good = ((a + b - x) / np.maximum(2 * np.sqrt(np.maximum(a * b, 0)), 1e-12) < limit).all()
        else:
            raise InvalidParameter(f"unknown rule {rule}")
        if good:
            kept.append(i)
    return kept


def truncation(n: int, dimension: int) -> float:
    """The radius of OPT-SNG; from a few vectors on it lies beyond the largest cosine distance, 2, and cuts nothing."""
    return max(1.0, math.log(max(n, 2)) * math.sqrt(dimension))


@dataclass
class CandidateEvolution:
    """Running mean and variance of candidate set sizes, each new size weighing a tenth."""

    mean: float = 0.0
    variance: float = 0.0
    steps: int = 0

    def update(self, size: int) -> CandidateEvolution:
        gap = size - self.mean
        if self.steps == 0:
            self.mean = float(size)
        else:
            self.mean += 0.1 * gap
            self.variance = 0.9 * self.variance + 0.1 * gap * gap
        self.steps += 1
        return self


def max_degree(n: int, radius: float) -> int:
    return int(min(256, max(16, math.ceil(n ** (2 / 3) * radius))))


def martingale_prune(order: np.ndarray, distances: np.ndarray, radius: float, most: int) -> np.ndarray:
    """The candidates (nearest first) within the radius, as many as ``most``."""
    return order[distances[order] <= radius][:most]


def cosine_distances(x: np.ndarray) -> np.ndarray:
    near = 1 - x @ x.T
    np.fill_diagonal(near, np.inf)
    return near


def both_ways(lists: list[set[int]], near: np.ndarray, degree: int, most: int, how) -> list[set[int]]:
    """Edges in both directions; a node with more than ``most`` is thinned again, and filled up with its nearest."""
    for i in range(len(lists)):
        for j in list(lists[i]):
            lists[j].add(i)
    for i in range(len(lists)):
        if len(lists[i]) > most:
            own = np.array(sorted(lists[i], key=lambda j: (near[i, j], j)))
            lists[i] = set(own[how(i, own, most)].tolist()) | set(own[:degree].tolist())
    return lists


def connected(lists: list[set[int]], near: np.ndarray) -> list[set[int]]:
    """One component: what isn't reached is linked from its nearest reached node."""
    n = len(lists)
    seen, todo = ({0}, [0]) if n else (set(), [])
    while len(seen) < n:
        while todo:
            for j in lists[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if len(seen) < n:
            rest, have = np.array(sorted(set(range(n)) - seen)), np.array(sorted(seen))
            a, b = np.unravel_index(near[np.ix_(rest, have)].argmin(), (len(rest), len(have)))
            i, j = int(rest[a]), int(have[b])
            lists[i].add(j)
            lists[j].add(i)
            seen.add(i)
            todo = [i]
    return lists


def build_graph(x: np.ndarray, degree: int, most: int, candidates: int, rule: str, alpha: float, angle: float) -> list[np.ndarray]:
    """Neighbour lists over unit vectors: thinned exact neighbours, half of them filled up with the nearest, both directions."""
    n, near = len(x), cosine_distances(x)
    first = np.argsort(near, axis=1, kind="stable")[:, : min(candidates, max(0, n - 1))]
    how = lambda i, order, k: thin(near[i], near, order, k, rule, alpha, angle)
    lists = [set(first[i][how(i, first[i], degree)].tolist()) | set(first[i][: max(1, degree // 2)].tolist()) for i in range(n)]
    return [np.array(sorted(v), np.int32) for v in connected(both_ways(lists, near, degree, most, how), near)]


def beam(x: np.ndarray, neighbours, q: np.ndarray, entries: list[int], width: int, allowed: np.ndarray | None = None, through: np.ndarray | None = None) -> tuple[list[tuple[float, int]], int]:
    """Best-first search: (distance, row) of the ``width`` nearest found, nearest first, and how many rows were compared.

    ``allowed`` rows alone are results, others are only walked through; ``through`` rows alone are walked through.
    """
    seen, front, best = set(), [], []

    def meet(new: list[int]) -> None:
        seen.update(new)
        for j, dj in zip(new, (1 - x[new] @ q).tolist(), strict=True):
            if len(best) < width or dj < -best[0][0]:
                heapq.heappush(front, (dj, j))
                if allowed is None or allowed[j]:
                    heapq.heappush(best, (-dj, j))
                    if len(best) > width:
                        heapq.heappop(best)

    if entries:
        meet(list(dict.fromkeys(entries)))
    while front:
        d, i = heapq.heappop(front)
        if len(best) >= width and d > -best[0][0]:
            break
        new = [j for j in neighbours(i).tolist() if j not in seen and (through is None or through[j])]
        if new:
            meet(new)
    return sorted((-d, i) for d, i in best), len(seen)


class Shard:
    """A stored shard, opened."""

    def __init__(self, row: dict, seeds: int, strategy: str, seed: int):
        self.n, self.dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(self.n, self.dim)
        self.levels = np.frombuffer(row["levels"], np.uint8)
        self.offsets = np.frombuffer(row["offsets"], "<i8").reshape(-1, self.n + 1)
        self.edges = np.frombuffer(row["edges"], "<i4")
        self.categories = None if row["categories"] is None else np.frombuffer(row["categories"], "<i8")
        self.top = int(self.levels.argmax()) if self.n else 0
        rng = np.random.default_rng(seed)
        self.random = rng.choice(self.n, min(self.n, seeds), replace=False).tolist() if strategy == "random" or len(self.offsets) == 1 else []

    def neighbours(self, layer: int):
        o, e = self.offsets[layer], self.edges
        return lambda r: e[o[r] : o[r + 1]]

    def entries(self, q: np.ndarray) -> tuple[list[int], int]:
        """Where the beam starts on the lowest layer, and how many rows were compared on the way down."""
        at, compared = [self.top], 0
        for layer in range(len(self.offsets) - 1, 0, -1):
            found, n = beam(self.x, self.neighbours(layer), q, at, 1)
            at, compared = [found[0][1]], compared + n
        return at + self.random, compared

    def search(self, q: np.ndarray, width: int, allowed: np.ndarray | None = None, within: bool = False) -> tuple[list[tuple[float, int]], int]:
        if not self.n:
            return [], 0
        if allowed is not None and (some := np.nonzero(allowed)[0]).size <= 4 * width:
            d = 1 - self.x[some] @ q  # a few rows: compared all
            order = np.argsort(d, kind="stable")[:width]
            return list(zip(d[order].tolist(), some[order].tolist(), strict=True)), len(some)
        start, compared = self.entries(q)
        through = None
        if within:  # along edges inside the category, from some of its rows
            through, start = allowed, np.nonzero(allowed)[0][:: max(1, int(allowed.sum()) // 16)].tolist()
        found, n = beam(self.x, self.neighbours(0), q, start, width, allowed, through)
        return found, compared + n

    def checked(self, q: np.ndarray, found: list[list[tuple[float, int]]], k: int, allowed: np.ndarray) -> list[list[tuple[float, int]]]:
        """The k nearest ``allowed`` rows of each of some queries, of ties the smaller id: what ``search`` found sets a bound, and the
        rows that it left out are compared with that."""
        some = np.nonzero(allowed)[0]
        s = np.round(q @ self.x[some].T, EXACT)
        out = []
        for own, got in zip(s, found, strict=True):
            bound = 1 - got[k - 1][0] - 10.0**-EXACT if 0 < k <= len(got) else -np.inf
            at = np.nonzero(own >= bound)[0]
            at = at[np.argsort(-own[at], kind="stable")[:k]]  # rows are in the order of ids
            out.append([(1 - v, r) for v, r in zip(own[at].tolist(), some[at].tolist(), strict=True)])
        return out


@dataclass
class GraphIndex:
    """A sharded graph. ``rule`` thins neighbours to ``degree``, or ``m_max`` on the lowest layer once edges go both ways.

    ``layered`` draws levels that thin out by the degree; ``strategy`` "stacked" enters by the layers, "random" by as many
    rows as ``seeds`` besides. ``category`` names an integer column for ``search_category``; each row then gets edges
    to its nearest of the same category. With ``exact`` the searches under a filter or within a category compare the rows
    that the walk left out as well, so that none of the nearest is missed.
    """

    degree: int = 16
    m_max: int = 0
    candidates: int = 200
    ef: int = 50
    rule: str = "rnd"
    alpha: float = 1.3
    angle: float = 60.0
    layered: bool = False
    strategy: str = "stacked"
    seeds: int = 1
    seed: int = 0
    shard_rows: int = SHARD_ROWS
    probes: int = PROBES
    category: str | None = None
    exact: bool = False
    shards: DataFrame | None = field(default=None, repr=False)
    rows: DataFrame | None = field(default=None, repr=False)
    source: DataFrame | None = field(default=None, repr=False)
    centroids: np.ndarray | None = field(default=None, repr=False)

    def _plain(self):
        """A copy without DataFrames, for the executors."""
        out = copy.copy(self)
        out.shards = out.rows = out.source = None
        return out

    def _named(self, vectors: DataFrame) -> DataFrame:
        kind = F.col(self.category).cast("long") if self.category else F.lit(None).cast("long")
        return vectors.filter("embedding IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), kind.alias("category"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the column cluster."""
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = (unit(matrix(batch.column(1))) @ c.T).argmax(axis=1) if len(c) > 1 else np.zeros(batch.num_rows, int)
                    yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32))], names=["doc_id", "embedding", "category", "cluster"])

        return rows.mapInArrow(run, "doc_id long, embedding array<double>, category long, cluster int")

    def build(self, vectors: DataFrame) -> GraphIndex:
        rows = self._named(vectors)
        n, dim = (int(v or 0) for v in rows.agg(F.count("*"), F.max(F.size("embedding"))).first())
        self.centroids = kmeans.fit(rows, -(-n // self.shard_rows)) if n > self.shard_rows else np.zeros((1, max(1, dim)))
        placed = self._placed(rows)
        if n > self.shard_rows:
            placed = materialize(placed, "graph-rows")
        sizes = materialize(placed.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(2 * self.shard_rows)).cast("int").alias("parts")), "graph-sizes")
        dealt = placed.join(sizes, "cluster").withColumn("shard", F.col("cluster").cast("long") * 65536 + F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        self.rows = materialize(dealt.select("doc_id", "embedding", "category", "cluster", "shard"), "graph-rows")
        self.shards = materialize(self._built(self.rows), "graph")
        self.source = vectors
        return self

    def add(self, vectors: DataFrame) -> GraphIndex:
        """Put further rows into the shards of their clusters, which are built again."""
        known = self.rows.groupBy("cluster").agg(F.collect_set("shard").alias("shards"))  # a row a cluster
        new = self._placed(self._named(vectors)).join(materialize(known, "graph-sizes"), "cluster", "left")
        free = F.col("cluster").cast("long") * 65536
        at = F.coalesce(F.element_at(F.array_sort("shards"), (F.pmod(F.xxhash64("doc_id"), F.size("shards")) + 1).cast("int")), free)
        new = materialize(new.select("doc_id", "embedding", "category", "cluster", F.when(F.col("shards").isNull(), free).otherwise(at).alias("shard")), "graph-rows")
        touched = materialize(new.select("shard").distinct(), "graph-sizes")
        again = materialize(self._built(self.rows.join(touched, "shard", "left_semi").unionByName(new)), "graph")
        self.shards = materialize(self.shards.join(touched, "shard", "left_anti").unionByName(again), "graph")
        self.rows = materialize(self.rows.unionByName(new), "graph-rows")
        more = vectors.select(*[c for c in self.source.columns if c in vectors.columns]) if self.source is not None else vectors
        self.source = more if self.source is None else self.source.unionByName(more, allowMissingColumns=True)
        return self

    def _built(self, rows: DataFrame) -> DataFrame:
        me = self._plain()

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            ids, x = table.column("doc_id").to_numpy(), unit(matrix(table.column("embedding").combine_chunks()))
            levels = me._levels(len(x))
            evolution = CandidateEvolution()
            layers = []
            for layer in range(int(levels.max(initial=0)) + 1):
                some = np.nonzero(levels >= layer)[0]
                full: list[np.ndarray] = [np.zeros(0, np.int32)] * len(x)
                for i, own in zip(some.tolist(), me._lists(x[some], layer, evolution), strict=True):
                    full[i] = some[own].astype(np.int32)
                layers.append(full)
            kinds = None
            if me.category:
                kinds = np.array([-1 if v is None else v for v in table.column("category").to_pylist()], "<i8")
                layers[0] = me._with_categories(x, layers[0], kinds)
            flat = [own for full in layers for own in full]
            ends = np.cumsum([len(v) for v in flat]).reshape(len(layers), -1)
            offsets = np.concatenate([np.append(0, ends[:-1, -1])[:, None], ends], axis=1) if len(x) else np.zeros((1, 1))
            edges = np.concatenate(flat).astype("<i4") if flat else np.zeros(0, "<i4")
            cells = [table.column("shard")[0].as_py(), table.column("cluster")[0].as_py(), len(x), x.shape[1], ids.astype("<i8").tobytes(), x.astype("<f8").tobytes(), levels.astype(np.uint8).tobytes(), offsets.astype("<i8").tobytes(), edges.tobytes(), None if kinds is None else kinds.tobytes(), evolution.mean, evolution.variance]
            forms = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.float64(), pa.float64()]
            return pa.table([pa.array([v], k) for v, k in zip(cells, forms, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        return rows.groupBy("shard").applyInArrow(run, SCHEMA)

    def _levels(self, n: int) -> np.ndarray:
        """Every row's highest layer: a level more has the chance 1 / degree."""
        if not self.layered:
            return np.zeros(n, int)
        draw = np.random.default_rng(self.seed).uniform(1e-12, 1, n)
        return np.minimum(np.floor(-np.log(draw) / math.log(max(2, self.degree))), 15).astype(int)

    def _lists(self, x: np.ndarray, layer: int, evolution: CandidateEvolution) -> list[np.ndarray]:
        most = (self.m_max or 2 * self.degree) if layer == 0 else self.degree
        return build_graph(x, self.degree, most, self.candidates, self.rule, self.alpha, self.angle)

    def _with_categories(self, x: np.ndarray, lists: list[np.ndarray], kinds: np.ndarray) -> list[np.ndarray]:
        """Further edges to the nearest rows of the same category."""
        out = [set(v.tolist()) for v in lists]
        for kind in np.unique(kinds[kinds >= 0]):
            some = np.nonzero(kinds == kind)[0]
            for i, own in zip(some.tolist(), build_graph(x[some], max(2, self.degree // 2), self.degree, self.candidates, self.rule, self.alpha, self.angle), strict=True):
                out[i] |= set(some[own].tolist())
        return [np.array(sorted(v), np.int32) for v in out]

    def edges(self) -> DataFrame:
        """(src, dst, layer): the stored graph by ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, offsets, edges = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["offsets"], "<i8").reshape(-1, row["n"] + 1), np.frombuffer(row["edges"], "<i4")
                    for layer, o in enumerate(offsets):
                        part = ids[edges[o[0] : o[-1]]]
                        yield pa.record_batch([pa.array(np.repeat(ids, np.diff(o))), pa.array(part), pa.array(np.full(len(part), layer, np.int32))], names=["src", "dst", "layer"])

        return self.shards.mapInArrow(run, "src long, dst long, layer int")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(to, qids, qdata): blocks of queries for the clusters that they probe."""
        c, probes = self.centroids, max(1, min(self.probes, len(self.centroids)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    q, ids = matrix(part.column(1)), part.column(0).cast(pa.int64()).to_numpy()
                    if q.shape[1] != c.shape[1]:
                        raise DimensionMismatch(f"{q.shape[1]} is not {c.shape[1]}")
                    near = np.argsort(-(unit(q) @ c.T), axis=1, kind="stable")[:, :probes]
                    for to in np.unique(near):
                        some = np.nonzero((near == to).any(axis=1))[0]
                        for j in range(0, len(some), 256):
                            at = some[j : j + 256]
                            yield pa.record_batch([pa.array([int(to)], pa.int32()), pa.array([ids[at].astype("<i8").tobytes()], pa.binary()), pa.array([q[at].astype("<f8").tobytes()], pa.binary())], names=["to", "qids", "qdata"])

        return queries.select("query_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "to int, qids binary, qdata binary")

    def _searched(self, queries: DataFrame, k: int, ef: int | None, masks: DataFrame | None = None, category: int | None = None, counted: bool = False) -> DataFrame:
        width, me, first = max(k, ef or self.ef), self._plain(), self._first(k, ef)
        shards = self.shards.withColumn("allowed", F.lit(None).cast("binary")) if masks is None else self.shards.join(masks, "shard")
        pairs = shards.join(self._asked(queries), F.col("cluster") == F.col("to"))
        names = ["query_id", "doc_id", "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row, me.seeds, me.strategy, me.seed)
                    qids, allowed = np.frombuffer(row["qids"], "<i8"), None
                    if category is not None:
                        allowed = shard.categories == category
                    elif row["allowed"] is not None:
                        allowed = np.isin(shard.ids, np.frombuffer(row["allowed"], "<i8"))
                    out: list[tuple] = []
                    asked = unit(np.frombuffer(row["qdata"], "<f8").reshape(len(qids), -1))
                    results = [shard.search(q, width, allowed, category is not None) for q in asked]
                    lists = [found for found, _ in results]
                    if me.exact and allowed is not None:
                        lists = shard.checked(asked, lists, first, allowed)
                    for i, found, (_, compared) in zip(qids.tolist(), lists, results, strict=True):
                        out += [(i, compared, 0.0)] if counted else [(i, int(shard.ids[r]), round(1 - d, EXACT)) for d, r in found[:first]]
                    columns = list(zip(*out, strict=True)) or [[], [], []]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

        return pairs.mapInArrow(run, "query_id long, doc_id long, score double")

    def _first(self, k: int, ef: int | None) -> int:
        """How many results a shard returns for a query."""
        return k

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None) -> DataFrame:
        return ranked(self._searched(queries, k, ef), k)

    def compared(self, queries: DataFrame, k: int = 10, ef: int | None = None) -> DataFrame:
        """(query_id, compared): with how many rows a search compares each query."""
        return self._searched(queries, k, ef, counted=True).groupBy("query_id").agg(F.sum("doc_id").alias("compared"))

    def search_filtered(self, queries: DataFrame, where: Column, k: int = 10, ef: int | None = None) -> DataFrame:
        """As ``search``, among rows of the source that match: others are walked through only. Where a shard has few, they
        are compared all; every shard is asked, as a cluster says nothing of the filter."""
        if self.source is None:
            raise InvalidParameter("a loaded index has no source to filter")
        some = self.rows.select("shard", "doc_id").join(self.source.filter(where).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")

        def packed(table: pa.Table) -> pa.Table:
            return pa.table([table.column("shard").slice(0, 1), pa.array([table.column("doc_id").to_numpy().astype("<i8").tobytes()], pa.binary())], names=["shard", "allowed"])

        masks = some.groupBy("shard").applyInArrow(packed, "shard long, allowed binary")
        every = copy.copy(self)
        every.probes = len(self.centroids)
        return ranked(every._searched(queries, k, ef, masks=masks), k)

    def search_category(self, queries: DataFrame, category: int, k: int = 10, ef: int | None = None) -> DataFrame:
        """As ``search``, within a category, along its own edges."""
        if not self.category:
            raise InvalidParameter("the index has no categories")
        every = copy.copy(self)
        every.probes = len(self.centroids)
        return ranked(every._searched(queries, k, ef, category=category), k)

    def save(self, path: str) -> None:
        self.shards.write.parquet(f"{path}/shards")
        self.rows.write.parquet(f"{path}/rows")
        spark = self.shards.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str, **options):
        """A stored index, with the options that its searches are to use."""
        index = cls(**options)
        index.shards, index.rows = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/rows")
        index.centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()])  # one a shard, about
        return index

    def stats(self) -> AnnStats:
        row = self.shards.agg(F.sum("n"), F.max("dim"), F.sum(F.octet_length("vectors") + F.octet_length("edges") + F.octet_length("ids"))).first()
        return AnnStats(*(int(v or 0) for v in row))


@dataclass
class Hnsw(GraphIndex):
    """Layers by drawn levels: m = degree neighbours a layer, m_max on the lowest one."""

    layered: bool = True


@dataclass
class Nsw(GraphIndex):
    """Nearest neighbours without thinning."""

    rule: str = "none"


@dataclass
class Sng(GraphIndex):
    """Neighbours within the truncation radius, pruned to the degree that follows from the size unless given, and thinned;
    the shards keep the running mean and variance of the numbers of candidates."""

    degree: int = 0
    seeds: int = 16

    def _lists(self, x: np.ndarray, layer: int, evolution: CandidateEvolution) -> list[np.ndarray]:
        n, near = len(x), cosine_distances(x)
        radius = truncation(n, x.shape[1])
        degree = self.degree or max_degree(n, radius)
        how = lambda i, order, k: thin(near[i], near, order, k, "rnd")
        order, lists = np.argsort(near, axis=1, kind="stable")[:, : max(0, n - 1)], []
        for i in range(n):
            held = martingale_prune(order[i], near[i], radius, max(self.candidates, degree))
            evolution.update(len(held))
            lists.append(set(held[how(i, held, degree)].tolist()) | set(held[:8].tolist()))
        return [np.array(sorted(v), np.int32) for v in connected(both_ways(lists, near, 8, 2 * degree, how), near)]


@dataclass
class Vamana(GraphIndex):
    """A random regular graph of degree ln n, thinned in two passes: by rrnd with alpha, then by rnd. A pass's candidates are a
    row's neighbours, theirs, and its nearest rows."""

    degree: int = 64
    seeds: int = 4

    def _lists(self, x: np.ndarray, layer: int, evolution: CandidateEvolution) -> list[np.ndarray]:
        n, near = len(x), cosine_distances(x)
        rng = np.random.default_rng(self.seed)
        few = min(max(0, n - 1), max(1, math.ceil(math.log(max(n, 2)))))
        lists = [set(int(j) for j in rng.choice(n, min(n, few + 1), replace=False) if j != i) for i in range(n)]
        first = np.argsort(near, axis=1, kind="stable")[:, : min(self.candidates, max(0, n - 1))]
        for rule, alpha in (("rrnd", self.alpha), ("rnd", 1.0)):
            how = lambda i, order, k, rule=rule, alpha=alpha: thin(near[i], near, order, k, rule, alpha)
            new = []
            for i in range(n):
                held = set(first[i].tolist()) | lists[i]
                for j in list(lists[i]):
                    held |= lists[j]
                held.discard(i)
                order = np.array(sorted(held), int)
                order = order[np.lexsort((order, near[i, order]))][: max(self.candidates, self.degree)]
                new.append(set(order[how(i, order, self.degree)].tolist()) | set(order[: self.degree // 4].tolist()))
            lists = both_ways(new, near, self.degree // 4, self.degree, how)
        return [np.array(sorted(v), np.int32) for v in connected(lists, near)]


@dataclass
class DiskAnn(Vamana):
    """A Vamana graph that is walked by product codes, which are all a shard holds in place of vectors; the rows found are
    rescored by the vectors, which stay in their own table and are read for those rows alone."""

    books: int = 0
    codes: int = 256
    reorder: int = 4
    quantizer: object | None = field(default=None, repr=False)

    def build(self, vectors: DataFrame) -> DiskAnn:
        from querent.operators.ann.quantize import ProductQuantizer, fitted

        dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
        books = self.books or max(b for b in range(1, dim + 1) if dim % b == 0 and b <= max(1, dim // 2))
        self.quantizer = fitted(vectors, ProductQuantizer(dim, books, self.codes))
        super().build(vectors)
        quantizer = self.quantizer

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("vectors")
                data = [quantizer.quantize(np.frombuffer(v.as_py(), "<f8").reshape(n.as_py(), -1)).astype("<u2").tobytes() for v, n in zip(batch.column("vectors"), batch.column("n"), strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(data, pa.binary()))

        self.shards = materialize(self.shards.mapInArrow(coded, SCHEMA), "graph")
        return self

    def add(self, vectors: DataFrame) -> DiskAnn:
        raise InvalidParameter("codes are fitted once; build the index again")

    def _first(self, k: int, ef: int | None) -> int:
        return max(k, ef or self.ef, self.reorder * k)

    def _searched(self, queries: DataFrame, k: int, ef: int | None, masks: DataFrame | None = None, category: int | None = None, counted: bool = False) -> DataFrame:
        if self.exact:
            raise InvalidParameter("a search by codes isn't exact")
        quantizer = self.quantizer

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("vectors")
                data = [unit(quantizer.decode(np.frombuffer(v.as_py(), "<u2").reshape(n.as_py(), -1).astype(int))).astype("<f8").tobytes() for v, n in zip(batch.column("vectors"), batch.column("n"), strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(data, pa.binary()))

        stored = copy.copy(self)
        stored.shards = self.shards.mapInArrow(decoded, SCHEMA)
        found = super(DiskAnn, stored)._searched(queries, k, ef, masks, category, counted)
        if counted:
            return found
        from querent.operators.rerank import rerank_cosine

        return rerank_cosine(found, self.rows.select("doc_id", "embedding"), queries, None).select("query_id", "doc_id", "score")

    def save(self, path: str) -> None:
        super().save(path)
        q = self.quantizer
        rows = [(b, i, c.tolist()) for b, book in enumerate(q.codebooks) for i, c in enumerate(book)]
        self.shards.sparkSession.createDataFrame(rows, "book int, code int, word array<double>").coalesce(1).write.parquet(f"{path}/codebooks")

    @classmethod
    def load(cls, spark, path: str, **options):
        from querent.operators.ann.quantize import ProductQuantizer

        index = super().load(spark, path, **options)
        books: list[list] = []
        for r in spark.read.parquet(f"{path}/codebooks").orderBy("book", "code").collect():  # codes * books words
            if r["book"] == len(books):
                books.append([])
            books[-1].append(r["word"])
        index.quantizer = ProductQuantizer(index.centroids.shape[1], len(books), max(map(len, books)), codebooks=[np.array(b) for b in books])
        return index
