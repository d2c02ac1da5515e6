"""Substring dedup by MinHash banding of paragraphs.

A text has paragraphs of two levels. Fine ones are pieces of lines: lines are cut where the content says so, before a word
whose pair with its predecessor has the smallest hash among the pairs within ``RADIUS`` words. So a passage is cut alike
wherever it stands, also inside other text, and one of more than 50 words mostly holds whole pieces (7 to about 30 words).
Pieces at the ends of a line are cut on one side only and count from 14 words; a line of 5 words or more that keeps no piece
is a piece as a whole. Coarse paragraphs are cut in the same way within ``WIDE`` words, over line breaks, and cover the whole
text, about 80 words each: long enough that a changed word or two leave a Jaccard similarity of 0.8. Every word is in one
of them, and a short text is one as a whole. Words that repeat with a period tie; only their first and last tie cut,
so a run of them is one paragraph.

Equal paragraphs form a class (a 64-bit hash of the words). MinHash signatures of five-word shingles are banded: 3 bands of 2
hashes for fine, 5 bands of 3 for coarse paragraphs, which two paragraphs of Jaccard similarity 0.8 share with a
probability of 0.953 and 0.972 (README has the recall measured). All classes that share a band are compared, by the exact
Jaccard similarity of their shingles: in lists of up to ``SMALL`` classes as pairs, in longer ones all in one task, or
in pairs of blocks if there are more than ``setlinks.BLOCK``. There the class whose shingles are the most frequent is compared with
all others first, which links most of a group of near copies, and then those left with all, in tiles; a spanning
forest of the links comes back and never all pairs. Linked classes form components, and components
that span several documents are reported: all their paragraphs but the first are removals.

Edge cases: null and empty texts have no paragraphs; fewer words than a shingle are one shingle; pieces of lines
below the sizes above are in coarse paragraphs only; repeats inside one document only aren't reported, unless ``within``
is given; rows with equal ids count as one document, a null id as a document of its own; ids have to be integers; in a
tie the smallest id and position stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.setlinks import BLOCK, block_links
from querent.operators.components import components
from querent.runtime import bounded_batches, materialize, table

RADIUS, INNER, EDGE = 6, 7, 14
WIDE = 40
SHINGLE, JACCARD = 5, 0.8
#: (bands, hashes of a band) of fine and of coarse paragraphs.
BANDING = ((3, 2), (5, 3))
#: Lists of more classes than SMALL are compared in one task or in blocks.
SMALL = 8
#: Classes that a task remembers, so as to post one that repeats once.
REMEMBERED = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MOST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxh64_intdigest(word)
        return found


#: Stand for line breaks and between texts; no words of UTF-8.
_LINE, _TEXT = b"\xff", b"\xfe"


def _window_min(x: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """The minimum of each element and the length - 1 after it, as far as they are in its segment."""
    out, width = x, 1
    while width < length:
        step = min(width, length - width)
        further = out.copy()
        same = segment[step:] == segment[:-step]
        further[:-step][same] = np.minimum(out[:-step][same], out[step:][same])
        out, width = further, width + step
    return out


def _pieces(h: np.ndarray, segment: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first, behind) of the pieces that the content cuts; the last two bound each piece's segment."""
    head = np.ones(len(h), bool)
    head[1:] = segment[1:] != segment[:-1]
    pair = np.full(len(h), _MOST)
    pair[1:] = np.where(head[1:], _MOST, _mixed(h[1:] * _A + h[:-1]))
    before = _window_min(pair[::-1].copy(), segment[::-1], radius + 1)[::-1]
    least = np.minimum(before, _window_min(pair, segment, radius + 1))
    ties = np.nonzero((pair == least) & (pair != _MOST))[0]
    # Ties within the radius are a chain, as in words that repeat; its first one cuts, and its last one if far enough.
    chain = np.ones(len(ties), bool)
    chain[1:] = (np.diff(ties) > radius) | (segment[ties[1:]] != segment[ties[:-1]])
    start, last = ties[chain], ties[np.append(chain[1:], True)] if len(ties) else ties
    head[start] = head[last[last - start >= INNER]] = True
    starts = np.nonzero(head)[0]
    ends = np.append(starts[1:], len(h))
    opens = np.nonzero(np.append(True, segment[1:] != segment[:-1]))[0] if len(h) else starts
    own = np.searchsorted(opens, starts, side="right") - 1
    return starts, ends, opens[own], np.append(opens[1:], len(h))[own]


class Cut:
    """The paragraphs of some texts: word hashes h of all, and for each paragraph start and end in h, text, number, level."""

    def __init__(self, texts: list[str | None], known: dict):
        words = (b" " + _TEXT + b" ").join([(t or "").encode().lower().replace(b"\n", b" " + _LINE + b" ") for t in texts]).split()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        line, text = h == np.uint64(known[_LINE]), h == np.uint64(known[_TEXT])
        real = ~(line | text)
        h, lines, texts_ = h[real], np.cumsum(line | text)[real], np.cumsum(text)[real]
        self.h = h
        a, b, first, behind = _pieces(h, lines, RADIUS)
        keep = b - a >= np.where((a == first) | (b == behind), EDGE, INNER)
        # A line that keeps no piece is one as a whole.
        some = np.zeros(len(h) + 1, bool)
        some[first[keep]] = True
        whole = (a == first) & ~some[first] & (behind - first >= SHINGLE)
        b, keep = np.where(whole, behind, b), keep | whole
        fine = np.stack([a[keep], b[keep]])
        a, b, first, behind = _pieces(h, texts_, WIDE)
        # A rest that is shorter than a shingle stays with its neighbour.
        inside = (a == first) | ((a - first >= SHINGLE) & (behind - a >= SHINGLE))
        a, behind = a[inside], behind[inside]
        coarse = np.stack([a, np.minimum(np.append(a[1:], len(h)), behind)])
        coarse = coarse[:, ~np.isin(coarse[0] * (len(h) + 1) + coarse[1], fine[0] * (len(h) + 1) + fine[1])]
        level = np.repeat([0, 1], [fine.shape[1], coarse.shape[1]])
        spans = np.concatenate([fine, coarse], axis=1)
        order = np.lexsort((spans[0], level, texts_[spans[0]]))
        self.starts, self.ends, self.level = spans[0][order], spans[1][order], level[order]
        self.text = texts_[self.starts]
        self.offset = np.searchsorted(texts_, self.text)  # of the text's first word
        self.number = np.arange(len(order)) - np.searchsorted(self.text, self.text)

    def classes(self) -> np.ndarray:
        """A hash of each paragraph's words, as int64: a polynomial in an odd number, from running sums."""
        up = np.cumprod(np.full(len(self.h) + 1, _A))
        down = np.cumprod(np.full(len(self.h), np.uint64(pow(int(_A), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * down)])
        value = up[self.ends] * (sums[self.ends] - sums[self.starts])
        return _mixed(_mixed(value) + (self.ends - self.starts).astype(np.uint64)).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the SHINGLE words from every word on, and behind which one each paragraph's end."""
        n = len(self.h)
        padded = np.append(self.h, np.zeros(SHINGLE, np.uint64))
        s = self.h.copy()
        for k in range(1, SHINGLE):
            s = s * _A + padded[k : k + n]
        short = self.ends - self.starts < SHINGLE
        s[self.starts[short]] = self.classes()[short].view(np.uint64)
        return _mixed(s), np.maximum(self.ends - SHINGLE + 1, self.starts + 1)

    def bands(self) -> list[np.ndarray]:
        """For each paragraph the keys of its bands: hashes of some of its shingles' smallest hashes."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.starts)
        s, behind = self.shingles()
        s = np.append(s, _MOST)  # so that an end may be the last
        for level, (count, rows) in enumerate(BANDING):
            own = np.nonzero(self.level == level)[0]
            if not len(own):
                continue
            at, keys = np.stack([self.starts[own], behind[own]], 1).ravel(), np.zeros((count, len(own)), np.uint64)
            for k in range(count * rows):
                seed = np.uint64(k + 1 + 100 * level) * _A
                keys[k // rows] = _mixed(keys[k // rows] * _A + np.minimum.reduceat(_mixed(s ^ seed), at)[::2] + seed)
            for i, row in zip(own.tolist(), keys.T.copy().view(np.int64), strict=True):
                out[i] = row
        return out


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Cut]]:
    """Runs of rows of about ``most`` bytes of text with their paragraphs."""
    known = _Words()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        mark = np.cumsum(sizes) // most
        for at in np.split(np.arange(batch.num_rows), np.nonzero(np.diff(mark))[0] + 1):
            if len(at):
                part = batch.slice(int(at[0]), len(at))
                yield part, Cut(part.column(column).to_pylist(), known)


UNITS = "class long, doc_id long, paragraph int, level int, start int, end int, bands array<long>"


def units(docs: DataFrame) -> DataFrame:
    """class, doc_id, paragraph, level, start, end (word offsets, end exclusive) of every paragraph, and its bands; these are
    left out where the task has lately given them for an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, c in _slices(batches, 1):
            kinds, bands = c.classes(), c.bands()
            for i, kind in enumerate(kinds.tolist()):
                if kind in seen:
                    bands[i] = None
                else:
                    seen.add(kind)
            if len(seen) > REMEMBERED:
                seen.clear()
            columns = [pa.array(kinds), part.column(0).take(pa.array(c.text)), *(pa.array(v.astype(np.int32)) for v in (c.number, c.level, c.starts - c.offset, c.ends - c.offset))]
            yield pa.record_batch([*columns, pa.array(bands, pa.list_(pa.int64()))], names=["class", "doc_id", "paragraph", "level", "start", "end", "bands"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, UNITS)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (band, class) sorted by both, each once, those whose band has several classes."""
    band = kind = None
    told = False
    for batch in batches:
        b, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if band is not None:  # carry the open list's latest class over
            b, c = np.append(band, b), np.append(kind, c)
        if not len(b):
            continue
        new = np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
        b, c = b[new], c[new]
        left = np.append(False, b[1:] == b[:-1])
        many = left | np.append(left[1:], False)
        if band is not None:
            many[0] &= not told
            told = told and bool(left.all())
        told = told or bool(left[-1])
        band, kind = b[-1], c[-1]
        yield pa.record_batch([pa.array(b[many]), pa.array(c[many])], names=["band", "class"])


def class_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, grams array) of the classes at wanted (doc_id, paragraphs array); equal ids may add other classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c in _slices(batches, 1):
            asked = {(i, p) for i, ps in enumerate(part.column(2).to_pylist()) for p in ps}
            pick = [k for k, at in enumerate(zip(c.text.tolist(), c.number.tolist(), strict=True)) if at in asked]
            s, ends = c.shingles()
            grams = [np.unique(s[c.starts[k] : ends[k]]).view(np.int64) for k in pick]
            yield pa.record_batch([pa.array(c.classes()[pick]), pa.array(grams, pa.list_(pa.int64()))], names=["class", "grams"])

    # Most documents hold a wanted paragraph, so texts meet the list by a shuffle at any size, and not by a broadcast at small ones.
    with_text = docs.select(F.col("doc_id").cast("long"), "text").alias("d").join(wanted.hint("merge").alias("w"), F.expr("d.doc_id <=> w.doc_id"))
    return with_text.select("d.doc_id", "d.text", "w.paragraphs").mapInArrow(run, "class long, grams array<long>").dropDuplicates(["class"])


def duplicates(docs: DataFrame, jaccard: float = JACCARD, within: bool = False) -> DataFrame:
    """doc_id, paragraph, level, start, end, n_words, component_id (the smallest doc_id that shares it), kept, for every
    paragraph that repeats, equal or with this Jaccard similarity or more, across documents, or ``within`` one as well."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(units(docs), "units")
    posted = found.filter("bands IS NOT NULL").select(F.explode("bands").alias("band"), "class")
    lists = posted.repartition(parts, "band").sortWithinPartitions("band", "class")
    members = materialize(lists.mapInArrow(shared, "band long, class long"), "members")
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("n")), "lists")
    near = materialize(members.select("class").distinct(), "near")
    each = found.groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "paragraph")).alias("at"), F.max("doc_id").alias("high"))
    each = each.join(near.withColumn("near", F.lit(True)), "class", "left").filter("n > 1 OR near")
    each = materialize(each.select("class", "n", "at", "high", F.coalesce("near", F.lit(False)).alias("near")), "classes")
    wanted = materialize(each.filter("near").groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_set("at.paragraph")).alias("paragraphs")), "wanted")
    grams = materialize(class_shingles(docs, wanted), "grams")
    few = members.join(sizes.filter(F.col("n") <= SMALL), "band")
    pairs = few.select("band", F.col("class").alias("a")).join(few.select("band", F.col("class").alias("b")), "band").filter("a < b").select("a", "b").distinct()
    one, two = grams.select(F.col("class").alias("a"), F.col("grams").alias("x")), grams.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    similar = materialize(pairs, "pairs").join(one, "a").join(two, "b").filter(common >= F.lit(jaccard) * (F.size("x") + F.size("y") - common)).select("a", "b")
    large = materialize(block_links(members, grams, sizes.filter(F.col("n") > SMALL), jaccard, BLOCK), "links")
    group = components(similar.unionByName(large)).select(F.col("node").alias("class"), "component")
    named = each.join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = materialize(named, "named")
    whole = named.groupBy("component").agg(F.min("at").alias("first"), F.max("high").alias("high"), F.sum("n").alias("n"))
    across = "" if within else " AND (first.doc_id <> high OR first.doc_id IS NULL AND high IS NOT NULL)"
    whole = materialize(whole.filter("n > 1" + across), "whole")
    of = materialize(named.join(whole.select("component", "first"), "component").select("class", "first"), "of")
    first = F.struct("doc_id", "paragraph") == F.col("first")
    return found.join(of, "class").select("doc_id", "paragraph", "level", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), F.col("first.doc_id").alias("component_id"), first.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents that repeats across documents."""
    return duplicates(table(spark, sf_dir, "documents"))
