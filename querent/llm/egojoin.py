"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors within cosine c of each other lie within epsilon = sqrt(2 - 2c). Vectors are rotated to their
principal axes, and sorted by their grid cells of width epsilon on the leading ones (the epsilon grid order), which
range-partitions them into a sequence of leaves. Intervals of the sequence form a tree with bounding boxes; starting
with the root and itself, pairs of intervals are joined with their children, level by level, and pairs of boxes more
than epsilon apart are skipped with all they hold. Each remaining pair of leaves is one row of work: inside it the
recursion goes on over halves, and tiles that can't be skipped are compared by a matrix product in double precision.

A pair of leaves returns one count for each vector that has links and a spanning forest of the links, never the
links themselves, so groups of near copies cost rows in proportion to their members. Equal vectors are compared
once and counted as often as they occur.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; shorter vectors
count as padded with zeros; a null id is kept as an id; equal ids are other vectors; ties don't matter, as links
depend on the pair alone; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.operators.components import components, roots
from querent.runtime import materialize, table

COSINE = 0.9
LEAF = 4096  # vectors of a leaf, about
FAN = 16  # children of an interval
AXES = 8  # leading principal axes of the order and of the boxes
TILE = 256
SLACK = 1e-9  # added to epsilon where boxes are compared; links are decided by the products alone


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _unit(raw: list[bytes], dim: int, form: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), form).astype(np.float64).reshape(-1, dim)
    # Scaling first keeps the squares of very large and very small components in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed_vectors(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """(vec_id, vec) with vec the components' bytes, null if invalid; the dimension; and the form of a component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = max(dim, 1)
    form = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(form) if x.is_valid and len(x) else None
                good = v is not None and np.isfinite(v).all() and v.any()  # null components arrive as NaN
                out.append(np.pad(v, (0, dim - len(v))).tobytes() if good else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vec binary"), dim, form


def principal_axes(vecs: DataFrame, dim: int, form: str) -> np.ndarray:
    """The principal axes of the unit vectors as columns, by falling variance; needs dim**2 sums from Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, LEAF):
                x = _unit(batch.column(0).slice(i, LEAF).to_pylist(), dim, form)
                total[:, :dim] += x.T @ x
                total[:, dim] += x.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    found = vecs.select("vec").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dim * (dim + 1))
    for at, value in found:
        total[at] = value
    total, n = total.reshape(dim, dim + 1), max(1, vecs.count())
    mean = total[:, dim] / n
    return np.linalg.eigh(total[:, :dim] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def _leaves(unique: DataFrame, dim: int, form: str, axes: np.ndarray, epsilon: float, count: int) -> DataFrame:
    """leaf (its place in the sequence), n, vecs, uids, weights, lo, hi: runs of the epsilon grid order."""
    lead = min(AXES, dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, LEAF):
                part = batch.slice(i, LEAF)
                at = _unit(part.column("vec").to_pylist(), dim, form) @ axes[:, :lead]
                cells = np.floor(at / epsilon).astype(np.int64).astype(">i8").view(np.uint8).reshape(len(at), 8 * lead).copy()
                cells[:, ::8] ^= 128  # so that bytes sort as the signed numbers do
                yield pa.record_batch([part.column("uid"), part.column("copies"), part.column("vec"), _packed(list(cells)), pa.array(at[:, 0])], names=["uid", "copies", "vec", "cells", "first"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            t = pa.Table.from_batches(held)
            while t.num_rows > LEAF or (final and t.num_rows):
                leaf, t = t.slice(0, LEAF), t.slice(LEAF)
                raw = leaf.column("vec").to_pylist()
                at = _unit(raw, dim, form) @ axes[:, :lead]
                columns = [pa.array([(part << 20) + number]), pa.array([leaf.num_rows], pa.int32()), pa.array([b"".join(raw)], pa.binary())]
                columns += [pa.array([leaf.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("uid", "copies")]
                columns += [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (at.min(axis=0), at.max(axis=0))]
                yield pa.record_batch(columns, names=["leaf", "n", "vecs", "uids", "weights", "lo", "hi"])
                number += 1
            held, size = t.to_batches(), t.num_rows

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * LEAF:
                yield from flush(False)
        if held:
            yield from flush(True)

    rows = unique.mapInArrow(keyed, "uid long, copies long, vec binary, cells binary, first double")
    parts = max(1, -(-count // LEAF))
    ordered = rows.repartitionByRange(parts, "cells", "first").sortWithinPartitions("cells", "first", "uid")
    return ordered.select("uid", "copies", "vec").mapInArrow(cut, "leaf long, n int, vecs binary, uids binary, weights binary, lo array<double>, hi array<double>")


def _apart(a: str, b: str, lead: int) -> Column:
    """Squared distance between two boxes on the leading axes."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{a}.lo")[k] - F.col(f"{b}.hi")[k], F.col(f"{b}.lo")[k] - F.col(f"{a}.hi")[k])
    return sum((gap(k) * gap(k) for k in range(lead)), F.lit(0.0))


def _pairs(boxes: DataFrame, lead: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: the pairs of leaves whose boxes may hold links, by recursive joins of intervals.

    boxes: leaf, lo, hi. An interval of the tree is numbered by its leaf numbers without trailing digits.
    """
    low = materialize(boxes.select(F.col("leaf").alias("node"), "lo", "hi"), "ego")
    levels = [low]
    while levels[-1].count() > 1:
        ends = [F.min(F.col("lo")[k]).alias(f"l{k}") for k in range(lead)] + [F.max(F.col("hi")[k]).alias(f"h{k}") for k in range(lead)]
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(*ends)
        up = up.select("node", F.array(*[f"l{k}" for k in range(lead)]).alias("lo"), F.array(*[f"h{k}" for k in range(lead)]).alias("hi"))
        levels.append(materialize(up, "ego"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    most = F.lit((epsilon + SLACK) ** 2)
    for level in reversed(levels[:-1]):
        child = level.withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
        left = pairs.join(child.alias("x"), F.col("a") == F.col("x.parent")).select("b", F.struct("x.node", "x.lo", "x.hi").alias("x"))
        both = left.join(child.alias("y"), (F.col("b") == F.col("y.parent")) & (F.col("x.node") <= F.col("y.node")) & (_apart("x", "y", lead) <= most))
        pairs = materialize(both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "ego")
    return pairs


def join_leaves(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, same: bool, axes: np.ndarray, cosine: float):
    """Links between the unit vectors x and y (the same ones if ``same``): for each side the summed weights of
    the partners, and a spanning forest as (i, j) with j counted from len(x) unless ``same``."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    sides = [(x @ axes, x, wx), (y @ axes, y, wy)]
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    nx, ny, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    shift = 0 if same else len(x)

    def box(side: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        key = (0 if same else side, a, b)
        if key not in boxes:
            boxes[key] = (sides[side][0][a:b].min(axis=0), sides[side][0][a:b].max(axis=0))
        return boxes[key]

    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a:  # the mirror image is done
            continue
        (l1, h1), (l2, h2) = box(0, a, b), box(1, c, d)
        gap = np.maximum(np.maximum(l1 - h2, l2 - h1), 0)
        if gap @ gap > epsilon * epsilon:
            continue
        if b - a > TILE or d - c > TILE:
            halves = [(a, b)] if b - a <= TILE else [(a, (a + b) // 2), ((a + b) // 2, b)]
            others = [(c, d)] if d - c <= TILE else [(c, (c + d) // 2), ((c + d) // 2, d)]
            stack += [(*p, *q) for p in halves for q in others]
            continue
        hits = x[a:b] @ y[c:d].T >= cosine
        own = same and a == c
        if own:
            np.fill_diagonal(hits, False)
        if not hits.any():
            continue
        nx[a:b] += hits @ wy[c:d]
        if not own:
            ny[c:d] += wx[a:b] @ hits
        i, j = np.nonzero(np.triu(hits) if own else hits)
        nodes, low = roots(i + a, j + c + shift)
        edges.append(np.stack([nodes[nodes != low], low[nodes != low]]))
    if same:
        nx, ny = nx + ny, np.zeros_like(ny)
    if edges:
        e = np.concatenate(edges, axis=1)
        nodes, low = roots(e[0], e[1])
        return nx, ny, nodes[nodes != low], low[nodes != low]
    return nx, ny, np.zeros(0, np.int64), np.zeros(0, np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    packed, dim, form = packed_vectors(vectors)
    packed = materialize(packed, "ego")
    unique = packed.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    unique = materialize(unique.withColumn("uid", F.monotonically_increasing_id()), "ego")
    axes = principal_axes(unique, dim, form)
    leaves = materialize(_leaves(unique.select("uid", "copies", "vec"), dim, form, axes, epsilon, unique.count()), "ego")
    pairs = _pairs(leaves.select("leaf", "lo", "hi"), min(AXES, dim), epsilon)
    one = leaves.select(F.col("leaf").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("vecs", "uids", "weights")])
    two = leaves.select(F.col("leaf").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("vecs", "uids", "weights")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, *rest = (batch.column(c)[row].as_py() for c in ("a", "b", "vecs_a", "uids_a", "weights_a", "vecs_b", "uids_b", "weights_b"))
                x, y = _unit([rest[0]], dim, form), _unit([rest[3]], dim, form)
                ux, wx, uy, wy = (np.frombuffer(v, "<i8") for v in (rest[1], rest[2], rest[4], rest[5]))
                nx, ny, hi, lo = join_leaves(x, y, wx, wy, a == b, axes, cosine)
                names = ux if a == b else np.concatenate([ux, uy])
                counts = np.concatenate([nx, ny])[: len(names)]
                some = counts > 0
                uid = np.concatenate([names[some], names[hi]])
                other = pa.array(np.concatenate([np.zeros(some.sum(), np.int64), names[lo]]), mask=np.arange(len(uid)) < some.sum())
                links = np.concatenate([counts[some], np.zeros(len(hi), np.int64)])
                yield pa.record_batch([pa.array(uid), other, pa.array(links)], names=["uid", "other", "links"])

    sent = pairs.join(one, "a").join(two, "b").select("a", "b", "vecs_a", "uids_a", "weights_a", "vecs_b", "uids_b", "weights_b")
    found = materialize(sent.mapInArrow(work, "uid long, other long, links long"), "ego")
    group = components(found.filter("other IS NOT NULL").select("uid", "other"))
    counts = materialize(found.groupBy("uid").agg(F.sum("links").alias("links")), "ego")
    named = unique.select("uid", "low", "copies").join(counts, "uid", "left").join(group.withColumnRenamed("node", "uid"), "uid", "left")
    named = materialize(named.select("uid", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "uid").alias("component")), "ego")
    least = materialize(named.groupBy("component").agg(F.min("low").alias("component_id")), "ego")
    of = named.join(least, "component").select("uid", "copies", "links", "component_id")
    known = materialize(unique.select("uid", "vec").join(of, "uid"), "ego")
    out = packed.join(known, "vec", "left")
    links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    name = F.when(F.col("uid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", links.alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
