"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Fingerprints that differ in at most 4 of 64 bits agree in at least 4 of their 8 bytes. The index posts every
distinct fingerprint under three positions at a time, for 20 triples chosen so that any 4 of 8 positions
contain one of them (a Turan system), so a posting list holds n / 2**24 fingerprints and not n / 2**8. Pairs
that meet in a list have their agreeing bytes tallied; those with 4 or more are verified by their bits.

Lists of near copies would give squared numbers of pairs. So each list first links its members to its smallest
and largest fingerprint, and those links' components are contracted; only members outside the component of
their list's smallest are then paired, and only with members of other components. No link between components
is lost, and a group of near copies costs one row a member.

``near_duplicates`` links fingerprints; ``similar`` and ``deduplicate`` link texts by the Jaccard similarity of their shingle
sets, with candidates from several fingerprints in an index of the same kind, and exact verification.

Edge cases: null and empty texts and those without words have fingerprint zero and link to each other; fewer
words than a shingle count as one; equal texts have equal fingerprints and are joined once; a component's name
is its smallest id, null only if all its ids are null; an empty table gives no rows; other columns are ignored.
``near_duplicates`` takes ids of any type, ``similar`` and ``deduplicate`` integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, comb, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.setlinks import block_links
from querent.operators.components import components
from querent.runtime import bounded_batches, materialize, table

WORDS, SEED, BITS = 4, 42, 4
#: Independent fingerprints of ``similar`` besides the text's own, each with an anchor of so many shingles: a pair of Jaccard
#: similarity 0.8 agrees in an anchor with a probability of 0.64 and then in one of 8 bytes with 0.81 at least, so it meets with 0.98.
ROUNDS, ANCHOR = 5, 2
#: In ``similar``, lists of more sets than SMALL are compared in a task, in blocks of about BLOCK.
SMALL, BLOCK = 8, 1024
#: Positions in three groups; a triple inside a group, or two of a group with one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(t for g in GROUPS for t in combinations(g, 3)) + tuple((*p, x) for i, g in enumerate(GROUPS) for p in combinations(g, 2) for x in GROUPS[(i + 1) % 3])
_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; of the whole sequence if it is shorter than one."""
    from xxhash import xxh64_intdigest as digest

    parts = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at \x20 \x09-\x0D only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes as a signed integer: bits set in over half of them; zero for none."""
    if not len(hashes):
        return 0
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]  # eight one-byte counters a word
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles as a signed integer."""
    return majority(shingle_hashes(text, words, seed))


def rehashed(hashes: np.ndarray, round_: int) -> np.ndarray:
    """Hashes that are independent of the given ones, one set for each round."""
    x = (hashes + np.uint64(0x9E3779B97F4A7C15 * (round_ + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _keys(fp: Column, first: Column) -> Column:
    """The keys under which a fingerprint is posted: number of the triple, counted from ``first``, then its three bytes."""
    keys = []
    for n, triple in enumerate(TRIPLES):
        key = first + F.lit(n).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    return F.array(*keys)


def _anchored(fp: Column, anchor: Column, round_: Column) -> Column:
    """The keys under which a fingerprint is posted beside an anchor: one for each of its bytes and their positions."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
    return F.array(*[F.xxhash64(anchor, round_, F.lit(p), byte(p)) for p in range(8)])


def _close(a: str, b: str, bits: int) -> Column:
    """The count filter on agreeing bytes, then the bits themselves."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    tally = sum((F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))
    return (tally >= 8 - bits) & (F.bit_count(differ) <= bits)


def linked(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component): components of fingerprints that differ in at most ``bits`` <= 4 bits, named by a fingerprint;
    those without a link to another one are left out."""
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees matches for 0 to 4 differing bits")
    single = prints.select("fp").distinct()
    posted = single.select("fp", F.explode(_keys(F.col("fp"), F.lit(0).cast("long"))).alias("key"))
    lists = materialize(posted.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter("first < last"), "simhash")
    members = materialize(posted.join(lists, "key"), "simhash")
    to_first = members.filter(F.col("fp") != F.col("first")).filter(_close("fp", "first", bits)).select("fp", F.col("first").alias("other"))
    to_last = members.filter(F.col("fp") != F.col("last")).filter(_close("fp", "last", bits)).select("fp", F.col("last").alias("other"))
    near = materialize(components(to_first.union(to_last)), "simhash")
    named = members.join(near.select(F.col("node").alias("fp"), F.col("component").alias("own")), "fp", "left")
    named = named.join(near.select(F.col("node").alias("first"), F.col("component").alias("main")), "first", "left")
    named = named.select("key", "fp", F.coalesce("own", "fp").alias("own"), F.coalesce("main", "first").alias("main"))
    rest = materialize(named.filter("own <> main"), "simhash")
    with_rest = materialize(named.join(rest.select("key").distinct(), "key", "left_semi"), "simhash")
    one, two = rest.alias("p"), with_rest.alias("q")
    once = (F.col("q.own") == F.col("q.main")) | (F.col("p.fp") < F.col("q.fp"))
    met = one.join(two, (F.col("p.key") == F.col("q.key")) & (F.col("p.own") != F.col("q.own")) & once & _close("p.fp", "q.fp", bits))
    between = components(met.select(F.col("p.own").alias("a"), F.col("q.own").alias("b"))).select(F.col("node").alias("own"), F.col("component").alias("all"))
    between = materialize(between, "simhash")
    within = near.select(F.col("node").alias("fp"), F.col("component").alias("own")).join(between, "own", "left").select("fp", F.coalesce("all", "own").alias("component"))
    alone = between.join(near.select(F.col("node").alias("own")), "own", "left_anti").select(F.col("own").alias("fp"), F.col("all").alias("component"))
    return materialize(within.union(alone), "simhash")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links, itself included) of every row."""
    prints = materialize(fingerprints(docs, words, seed), "simhash")
    group = linked(prints, bits)
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(group, "fp", "left")
    lowest = materialize(lowest.select("fp", "low", F.coalesce("component", "fp").alias("component")), "simhash")
    named = materialize(lowest.groupBy("component").agg(F.min("low").alias("component_id")), "simhash")
    of = materialize(lowest.select("fp", "component").join(named, "component").select("fp", "component_id"), "simhash")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, words: int, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, class (a hash of the set of shingles), size (their number), wide (the set's fingerprint and ``rounds``
    independent ones) and anchors (one for each of these: a hash of the ``ANCHOR`` shingles that are the smallest by as many
    independent hashes) of every row. Repeats don't count, as they don't in the similarity of sets."""
    from xxhash import xxh64_intdigest as digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sizes, wide, anchors = [], [], [], []
            for x in batch.column(1):
                once = np.unique(shingle_hashes(x.as_py(), words, seed))
                kinds.append(digest(once.tobytes()))
                sizes.append(len(once))
                wide.append([majority(once), *(majority(rehashed(once, k)) for k in range(rounds))])
                least = np.array([rehashed(once, rounds + k).min(initial=2**64 - 1) for k in range((rounds + 1) * ANCHOR)], np.uint64)
                anchors.append([digest(a.tobytes()) for a in least.reshape(-1, ANCHOR)])
            anchors_ = [np.array(a, np.uint64).view(np.int64) for a in anchors]
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (wide, anchors_)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(kinds, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *lists], names=["doc_id", "class", "size", "wide", "anchors"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, class long, size int, wide array<long>, anchors array<long>")


def shingle_sets(docs: DataFrame, words: int, seed: int = SEED) -> DataFrame:
    """class and grams: the sorted distinct shingle hashes of every row, and their hash."""
    from xxhash import xxh64_intdigest as digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingle_hashes(x.as_py(), words, seed)) for x in batch.column(0)]
            kinds = np.array([digest(g.tobytes()) for g in grams], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(kinds), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))], names=["class", "grams"])

    return bounded_batches(docs.select("text")).mapInArrow(run, "class long, grams array<long>")


def sets_of(docs: DataFrame, kinds: DataFrame, asked: DataFrame, words: int, seed: int = SEED) -> DataFrame:
    """(class, grams) of the classes in ``asked``, each from one document."""
    ids = materialize(kinds.join(asked, "class", "left_semi").select("doc_id").distinct(), "simhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return materialize(shingle_sets(texts, words, seed).dropDuplicates(["class"]), "simhash")


def verified(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, words: int, jaccard: float, seed: int = SEED) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets of shingles have this Jaccard similarity."""
    grams = sets_of(docs, kinds, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), words, seed)
    sides = pairs.join(grams.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(sides.filter(common >= F.lit(jaccard) * (F.size("x") + F.size("y") - common)).select("a", "b"), "simhash")


def far(jaccard: float, bits: int) -> int:
    """The number of ``bits`` bits of fingerprints that sets of this Jaccard similarity differ in at most.

    By their counts of common and own shingles: few are the worst, 4 of 5 at 0.8, which differ in 0.1875 of the bits, many
    come to the angle between the sets. Seven standard deviations are added, which leaves out one pair in 10**11.
    """
    if jaccard <= 0:
        return bits
    worst = acos(min(2 * jaccard / (1 + jaccard), 1)) / pi
    for n in {*range(2, 41), ceil(1 / (1 - jaccard)) if jaccard < 1 else 2}:
        for own in range(int((1 - jaccard) * n + 1e-9) + 1):
            worst = max([worst, *(_differ(n - own, k, own - k) for k in range(own // 2 + 1))])
    return min(bits, ceil(bits * worst + 7 * (bits * worst * (1 - worst)) ** 0.5))


def _differ(common: int, a: int, b: int) -> float:
    """The chance that a bit differs between the majorities over ``common`` hashes and ``a`` or ``b`` further ones."""

    def over(own: int, k: int) -> float:
        return sum(comb(own, i) for i in range(own + 1) if 2 * (k + i) > common + own) / 2**own

    each = [(comb(common, k) / 2**common, over(a, k), over(b, k)) for k in range(common + 1)]
    return sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in each)


def listed_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, class, first) from rows (band, class) sorted by both: each class but the first of a list, with the first."""
    band, first, last = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        carried = 0
        if band is not None:  # carry the open list's first and latest class over
            b, c = np.concatenate([[band, band], b]), np.concatenate([[first, last], c])
            carried = 1 + (first != last)
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        b, c = b[new], c[new]
        head = np.ones(len(b), bool)
        head[1:] = b[1:] != b[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
        band, first, last = b[-1], c[start[-1]], c[-1]
        head[:carried] = True  # told before
        yield pa.record_batch([pa.array(b[~head]), pa.array(c[~head]), pa.array(c[start][~head])], names=["band", "class", "first"])


def listed_pairs(jaccard: float, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b) from rows (band, class, own, size, wide) sorted by band and class: the pairs of classes of a list, a < b,
    that are in different components, and whose sizes and fingerprints don't rule this similarity out. A pair is told once a
    batch, and again for lists in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            band, kind, own, size = (rows.column(c).to_numpy() for c in ("band", "class", "own", "size"))
            wide = pc.list_flatten(rows.column("wide")).to_numpy().reshape(len(band), -1)
            tail = int(np.searchsorted(band, band[-1]))  # the open list is told of later rows only
            fresh = 0 if held is None else held.num_rows
            found = [np.zeros((0, 2), np.int64)]
            step = 1
            while step < len(band) and (near := band[step:] == band[:-step]).any():
                i = np.nonzero(near)[0]
                i = i[i + step >= fresh]
                j = i + step
                i, j = (v[(own[i] != own[j]) & (np.minimum(size[i], size[j]) >= jaccard * np.maximum(size[i], size[j]))] for v in (i, j))
                close = np.bitwise_count((wide[i] ^ wide[j]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= bits
                found.append(np.sort(np.stack([kind[i[close]], kind[j[close]]], axis=1), axis=1))
                step += 1
            pairs = np.unique(np.concatenate(found), axis=0)
            held = rows.slice(tail).to_batches()[0]
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def similar(docs: DataFrame, words: int = 5, jaccard: float = 0.8, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(node, component): components, named by the smallest id, of ids whose rows' shingle sets have this Jaccard similarity.

    Rows with equal sets are a class. Similar rows' fingerprints may differ in a dozen bits, more than the index of one
    fingerprint is sure to find; so every class is posted with its fingerprint and ``rounds`` independent ones. Lists of byte
    positions alone would grow with the number of texts, and chance pairs with its square; so a list is one of a byte position beside
    an anchor, which unrelated texts don't share. All pairs
    that meet in a list count: each class is first compared with the one that is the first of most of its lists, the components of
    the links found are contracted, and members outside the component of their list's first are then compared with all
    members in other components: in lists of up to ``SMALL`` where the list is read (``listed_pairs``), and rows are made only of
    pairs whose sizes and whose fingerprints together (``far``) don't rule the similarity out; in longer lists in tiles
    (``setlinks``). All links are verified by the shingles: no row is linked unverified.
    """
    spark = docs.sparkSession
    named = docs.filter("doc_id IS NOT NULL")
    every = materialize(sketches(named, words, rounds, seed), "simhash")
    kinds = materialize(every.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("wide").alias("wide"), F.first("anchors").alias("anchors")), "simhash")
    keys = F.flatten(F.transform(F.arrays_zip("wide", "anchors"), lambda x, k: _anchored(x["wide"], x["anchors"], k)))
    posted = kinds.select(F.explode(keys).alias("band"), "class")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = posted.repartition(parts, "band").sortWithinPartitions("band", "class")
    members = materialize(lists.mapInArrow(listed_members, "band long, class long, first long"), "simhash")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(kinds.select(F.col("class").alias("a"), F.col("size").alias("m"), F.col("wide").alias("x")), "a")
        both = both.join(kinds.select(F.col("class").alias("b"), F.col("size").alias("n"), F.col("wide").alias("y")), "b")
        both = both.filter(F.least("m", "n") >= F.lit(jaccard) * F.greatest("m", "n"))
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
        return both.filter(differ <= far(jaccard, 64 * (rounds + 1))).select("a", "b")

    votes = members.groupBy("class", "first").agg(F.count("*").alias("n")).groupBy("class").agg(F.max_by("first", F.struct("n", "first")).alias("a"))
    tried = materialize(likely(votes.select("a", F.col("class").alias("b"))), "simhash")
    links = verified(named, kinds, tried, words, jaccard, seed)
    near = materialize(components(links), "simhash")
    owned = members.join(near.select(F.col("node").alias("class"), F.col("component").alias("own")), "class", "left")
    owned = owned.join(near.select(F.col("node").alias("first"), F.col("component").alias("main")), "first", "left")
    owned = owned.select("band", "class", "first", F.coalesce("own", "class").alias("own"), F.coalesce("main", "first").alias("main"))
    rest = materialize(owned.filter("own <> main"), "simhash")
    heads = rest.select("band", F.col("first").alias("class"), "first", F.col("main").alias("own"), "main").distinct()
    with_rest = materialize(owned.join(rest.select("band").distinct(), "band", "left_semi").unionByName(heads), "simhash")
    sizes = materialize(with_rest.groupBy("band").agg(F.countDistinct("class").alias("n")), "simhash")
    few = with_rest.join(sizes.filter(F.col("n") <= SMALL).select("band"), "band", "left_semi")
    few = few.select("band", "class", "own").join(kinds.select("class", "size", "wide"), "class").select("band", "class", "own", "size", "wide")
    met = few.repartition(parts, "band").sortWithinPartitions("band", "class").mapInArrow(listed_pairs(jaccard, far(jaccard, 64 * (rounds + 1))), "a long, b long")
    met = materialize(met.distinct().join(tried, ["a", "b"], "left_anti"), "simhash")
    others = verified(named, kinds, met, words, jaccard, seed)
    # Longer lists in a task each, so that a group of texts that are alike but not enough makes no rows of pairs.
    long_ = sizes.filter(F.col("n") > SMALL)
    many = materialize(with_rest.join(long_.select("band"), "band", "left_semi").select("band", "class").distinct(), "simhash")
    grams = sets_of(named, kinds, many.select("class").distinct(), words, seed).filter(F.size("grams") > 0)
    others = others.unionByName(materialize(block_links(many, grams, long_, jaccard, BLOCK), "simhash"))
    # Links join classes first, so that one row a class, and not one a link, meets the ids.
    group = components(links.unionByName(others)).select(F.col("node").alias("class"), F.col("component").alias("group"))
    group = materialize(group.join(kinds.select("class", "doc_id"), "class"), "simhash")
    low = group.join(group.groupBy("group").agg(F.min("doc_id").alias("low")), "group").select("class", "low")
    low = materialize(kinds.select("class", "doc_id").join(low, "class", "left").select("class", F.coalesce("low", "doc_id").alias("low")), "simhash")
    return components(every.join(low, "class").select("doc_id", "low"))


def deduplicate(docs: DataFrame, words: int = 5, jaccard: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id, columns unchanged. Rows without id can't be
    named and stay; of rows with equal ids that stay, one does."""
    gone = materialize(similar(docs, words, jaccard).filter("node <> component").select(F.col("node").alias("doc_id")), "simhash")
    again = materialize(docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "simhash")
    kept = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    # Only rows whose ids repeat need to meet; the others stay where they are.
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = kept.join(again, "doc_id", "left_anti").unionByName(docs.filter(F.col("doc_id").isNull()))
    return rest.unionByName(once).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
