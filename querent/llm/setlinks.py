"""Links by exact Jaccard similarity inside lists of sets that share a key, without rows for pairs.

A list is compared in one task. The set whose members are the most frequent is compared with all others first, which links
most of a group of near copies; those left are then compared with all, in tiles by products of incidence matrices, and tiles
that one component already holds or whose sizes rule the similarity out are skipped. What comes back are links enough to
join what all links would join, fewer than the list has sets. Lists of more than a block are dealt over blocks, and pairs of
blocks compared alike, so a task holds two blocks at most; blocks bring along what is joined inside them, so that a pair gives
back what it joins besides, at most one link for each of their components. Empty sets don't occur; equal sets and repeated rows
are linked like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.components import roots
from querent.runtime import materialize

#: Sets of a block, about, and of a tile.
BLOCK, TILE = 8192, 256


def _hits(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, jaccard: float) -> np.ndarray:
    """Which of the sets ``one`` and ``two`` (numbers of sets) have this Jaccard similarity, as a matrix."""
    both = np.concatenate([one, two])
    row = np.repeat(np.arange(len(both)), sizes[both])
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[both]) - sizes[both], sizes[both]) + np.repeat(starts[both], sizes[both])
    _, gram, times = np.unique(at[place], return_inverse=True, return_counts=True)
    some = times[gram] > 1  # what one set alone holds is in no other
    rank = np.cumsum(times > 1) - 1
    held = np.zeros((len(both), max(1, int((times > 1).sum()))), np.float32)
    held[row[some], rank[gram[some]]] = 1
    common = (held[: len(one)] @ held[len(one) :].T).astype(np.float64)
    return common >= jaccard * (sizes[one][:, None] + sizes[two][None, :] - common)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels of sets after those labelled ``a`` and ``b`` are joined: the smallest set of each component."""
    nodes, low = roots(a, b)
    to = np.arange(len(label))
    to[nodes] = low
    return to[label]


def set_links(grams: np.ndarray, sizes: np.ndarray, jaccard: float, split: int | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links between sets that join what all links between them join; ``grams`` holds the sets one behind the other.
    With ``split`` only those between the sets below and from it on are sought. ``known`` are the smallest sets of the
    components that are joined already; then it is these sets that are linked."""
    n, starts = len(sizes), np.cumsum(sizes) - sizes
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    pivot = int((np.add.reduceat(times[at], starts) / sizes).argmax())
    mark = np.zeros(len(times), bool)
    mark[at[starts[pivot] : starts[pivot] + sizes[pivot]]] = True
    common = np.add.reduceat(mark[at].astype(np.int64), starts)
    main = common >= jaccard * (sizes + sizes[pivot] - common)
    start = np.arange(n) if known is None else known
    label = _joined(start, start[main], np.full(int(main.sum()), start[pivot]))
    order = np.lexsort((sizes, main))  # those left first
    sides = [order] if split is None else [order[order < split], order[order >= split]]
    tiles = [[side[i : i + TILE] for i in range(0, len(side), TILE)] for side in sides]
    for i, one in enumerate(tiles[0]):
        for two in tiles[0][i:] if split is None else tiles[1]:
            if (label[one] == label[two[0]]).all() and (label[two] == label[two[0]]).all() or sizes[one].max() < jaccard * sizes[two].min() or sizes[two].max() < jaccard * sizes[one].min():
                continue
            x, y = np.nonzero(_hits(at, starts, sizes, one, two, jaccard))
            label = _joined(label, label[one[x]], label[two[y]])
    i = np.nonzero((start == np.arange(n)) & (label != start))[0]
    return i, label[i]


def opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = rows.column("grams").combine_chunks()
    return rows.column("class").to_numpy(), pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64), grams.flatten().to_numpy()


def block_links(members: DataFrame, grams: DataFrame, sizes: DataFrame, jaccard: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join what all links inside the lists join: ``members`` (band, class), ``grams`` (class, grams), and the
    lists' ``sizes`` (band, n). A list of more than about ``block`` classes is dealt over blocks, and pairs of them are compared."""
    dealt = members.join(sizes, "band").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class", "band"), F.col("blocks")).cast("int"))
    dealt = dealt.join(grams, "class").select("band", "block", "blocks", "class", "grams")

    columns = ("classes", "sizes", "grams", "labels")

    def within(rows: pa.Table) -> pa.Table:
        kinds, counts, sets = opened(rows)
        i, j = set_links(sets, counts, jaccard)
        return pa.table([pa.array(kinds[i]), pa.array(kinds[j])], names=["a", "b"])

    def packed(rows: pa.Table) -> pa.Table:
        """One row of a block: its classes, the sizes of their sets, the sets, and the smallest set that each is joined to."""
        kinds, counts, sets = opened(rows)
        label = np.arange(len(kinds))
        i, j = set_links(sets, counts, jaccard)
        label[i] = j
        own = [pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (kinds, counts, sets, label)]
        return pa.table([rows.column(c).slice(0, 1) for c in ("band", "block", "blocks")] + own, names=["band", "block", "blocks", *columns])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kinds, label = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in ("classes", "labels"))
                i = np.nonzero(label != np.arange(len(label)))[0]
                yield pa.record_batch([pa.array(kinds[i]), pa.array(kinds[label[i]])], names=["a", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = ([np.frombuffer(batch.column(c + end)[k].as_py(), "<i8") for c in columns] for end in ("", "_"))
                split = len(one[1])
                kinds, counts, sets, known = (np.concatenate(v) for v in zip(one, (*two[:3], two[3] + split), strict=True))
                i, j = set_links(sets, counts, jaccard, split, known)
                yield pa.record_batch([pa.array(kinds[i]), pa.array(kinds[j])], names=["a", "b"])

    found = dealt.filter("blocks = 1").groupBy("band", "block").applyInArrow(within, "a long, b long")
    form = "band long, block int, blocks int, " + ", ".join(f"{c} binary" for c in columns)
    blocks = materialize(dealt.filter("blocks > 1").groupBy("band", "block").applyInArrow(packed, form), "blocks")
    found = found.unionByName(blocks.select("classes", "labels").mapInArrow(inside, "a long, b long"))
    other = blocks.select(F.col("band").alias("band_"), F.col("block").alias("to"), *[F.col(c).alias(f"{c}_") for c in columns])
    pairs = blocks.filter("block + 1 < blocks").select("*", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("to_"))
    pairs = pairs.join(other, (F.col("band") == F.col("band_")) & (F.col("to") == F.col("to_")))
    return found.unionByName(pairs.select(*columns, *[f"{c}_" for c in columns]).mapInArrow(between, "a long, b long"))
