r"""Toxicity by compression distance: two zstandard dictionaries, window lengths and calibrated thresholds.

Training takes a bounded sample of labelled rows (``Bounds``). From two thirds of it come the dictionaries: a
class's dictionary is made of the segments of its texts that are covered by byte 5-grams far more frequent in
its texts than in the other's, most frequent segments last, where offsets are cheapest. (Dictionaries that zstandard's own
trainer makes of the classes' texts, or of those segments, tell windows apart far worse: what is toxic is a few words in
a hundred, which such a dictionary holds among much that both classes share. README has the figures.)

A text is scored by compressing its windows of 24 bytes (and 12 more, so that no word is cut in all windows) with either
dictionary; a window's gain is how many bytes the toxic one saves over the ordinary one. Every window begins with a mark
that both dictionaries hold, so the fixed cost of a compressed block weighs on both alike. The other third of the
sample calibrates: how much likelier each gain is in a toxic text's windows than in an ordinary one's, made monotone
in the gain; and a logistic regression that turns a text's sum, maximum and mean of these into a score of 0 to 1.

Whole texts are scored, in windows, so memory is bounded; nothing but the text enters a score. Edge cases: null
and empty texts have no gains and get the score of that; a sample without toxic or without ordinary rows gives a
model that scores the labels' mean everywhere (0 without labels); labels that repeat for an id count once, as
toxic if any is; null labels don't count; a null id is hashed as the empty string, and ids of any type are taken; repeated
rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.runtime import bounded_batches, materialize, table

GRAM, WINDOW, OVERLAP = 5, 24, 12
#: Gains are told apart up to this many bytes either way; a text's sum of likelihoods counts up to ``MOST_SUM``.
MOST_GAIN, MOST_SUM = 12, 30.0
#: Bytes that texts don't hold; all windows and both dictionaries share them.
MARK = bytes(b for b in range(1, 32) if b not in b"\t\n\v\f\r\x1b\x1c\x1d\x1e\x1f")[:16]
FOLDS = 5
#: UTF-8 continuation bytes in an order without repeats of five, which no text holds: it brings dictionaries to one
#: size, so that offsets cost alike, and stands behind the mark, as zstandard doesn't index a dictionary's last bytes.
FILLER = bytes(0x80 | (i * i * 7 + i // 64 * 13 + i * 29) % 64 for i in range(16384))


@dataclass(frozen=True)
class Bounds:
    """The labelled rows a model is fitted on: at most so many of each class, none longer than ``bytes_each``."""

    toxic: int = 2250
    ordinary: int = 4500
    bytes_each: int = 32 << 10
    dictionary: int = 4096


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the log likelihood ratios of gains from -MOST_GAIN to MOST_GAIN, and the weights of their sum,
    maximum and mean; without dictionaries ``bias`` alone counts."""

    toxic: bytes
    ordinary: bytes
    levels: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def plain(text: str | None) -> bytes:
    """What is compressed: UTF-8, A-Z in lower case, white space as single spaces."""
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def _grams(data: bytes) -> np.ndarray:
    """The number of each of the data's 5-grams, in order."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | x[i : i + len(out)]
    return out


def _counts(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(5-grams, texts that hold each, occurrences of each, up to ``most`` a text), folded a few texts at a time."""
    grams, held, often = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 128):
        each = [np.unique(_grams(t), return_counts=True) for t in texts[i : i + 128]]
        every = np.concatenate([grams, *(g for g, _ in each)])
        texts_, times = np.ones(len(every), np.int64), np.concatenate([often, *(np.minimum(n, most) for _, n in each)])
        texts_[: len(grams)] = held
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.nonzero(np.append(True, every[1:] != every[:-1]))[0] if len(every) else np.zeros(0, np.int64)
        grams = every[first]
        held, often = (np.add.reduceat(v[order], first) if len(first) else v for v in (texts_, times))
    return grams, held, often


def _segments(data: bytes, chosen: np.ndarray) -> set[bytes]:
    """The maximal runs of ``data`` that chosen 5-grams cover."""
    at = np.nonzero(np.isin(_grams(data), chosen))[0]
    if not len(at):
        return set()
    cut = np.nonzero(np.diff(at) >= GRAM)[0]
    return {data[a : b + GRAM] for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)}


def dictionary(own: list[bytes], other: list[bytes], size: int, ratio: float = 6.0, share: float = 0.03, most: int = 4) -> bytes:
    """Segments of ``own`` made of 5-grams that more than this share of its texts hold, and whose occurrences (up to ``most`` a
    text) are a part of all that exceeds ``ratio`` times that in ``other``."""
    mine, held, often = _counts(own, most)
    theirs, _, there = _counts(other, most)
    rest = np.zeros(len(mine))
    if len(theirs):
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        rest = np.where(theirs[at] == mine, there[at], 0.0)
    chosen = mine[(held >= 3) & (held > share * len(own)) & (often * max(1, there.sum()) > ratio * (rest + 1) * max(1, often.sum()))]
    whole = size + 512
    found = Counter()
    for t in own:
        found.update(_segments(t, chosen))
    kept: list[bytes] = []
    for s, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if n < 2 or size < 0:
            break
        if not any(s in k for k in kept):
            kept.append(s)
            size -= len(s) + 1
    body = b"\x7f".join([*reversed(kept), MARK]) + FILLER[-24:]
    return FILLER[: max(0, whole - len(body))] + body


class Scorer:
    """Gains and scores of texts under a model."""

    def __init__(self, model: Model):
        import zstandard as zs

        self.model, self.squeeze, self.levels = model, [], np.array(model.levels)
        for data in (model.ordinary, model.toxic) if model.weights else ():
            how = {"window_log": 15, "hash_log": 14, "chain_log": 14, "search_log": 8, "min_match": GRAM, "target_length": 64, "strategy": zs.STRATEGY_LAZY2, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
            known = zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=zs.ZstdCompressionParameters(**how))
            self.squeeze.append(zs.ZstdCompressor(dict_data=known, compression_params=zs.ZstdCompressionParameters(**how)))

    def gains(self, text: str | None, chunk: int = 4096) -> np.ndarray:
        """How many windows of the text have each gain from -MOST_GAIN to MOST_GAIN, larger ones counted at the ends."""
        data, found = plain(text), np.zeros(2 * MOST_GAIN + 1, np.int64)
        if len(data) <= 2:
            return found
        for at in range(0, len(data), chunk * WINDOW):
            windows = [MARK + data[i : i + WINDOW + OVERLAP] for i in range(at, min(len(data), at + chunk * WINDOW), WINDOW)]
            ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=1)), np.int64, len(windows)) for c in self.squeeze)
            found += np.bincount(np.clip(ordinary - toxic, -MOST_GAIN, MOST_GAIN) + MOST_GAIN, minlength=len(found))
        return found

    def features(self, gains: np.ndarray) -> tuple[float, float, float]:
        if not gains.any():
            return 0.0, 0.0, 0.0
        total = float(gains @ self.levels)
        return float(np.clip(total, -MOST_SUM, MOST_SUM)), float(self.levels[gains > 0].max()), 10 * total / float(gains.sum())

    def score(self, text: str | None) -> float:
        m = self.model
        if not m.weights:
            return m.bias
        z = m.bias + sum(w * x for w, x in zip(m.weights, self.features(self.gains(text)), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _levels(toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, ...]:
    """Log likelihood ratios of gains from the windows counted, neighbours pooled where they would fall."""
    one, two = toxic + 1.0, ordinary + 1.0
    ratio = np.log(one / one.sum()) - np.log(two / two.sum())
    pools: list[list[float]] = []
    for x, n in zip(ratio.tolist(), (one + two).tolist(), strict=True):
        pools.append([x, n, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (x2, n2, k2), (x1, n1, k1) = pools.pop(), pools.pop()
            pools.append([(x1 * n1 + x2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return tuple(x for x, _, k in pools for _ in range(int(k)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[tuple[float, ...], float]:
    """Weights and bias of a ridge logistic regression, by Newton steps; likelihoods never count against toxicity."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penalty = np.full(len(beta), ridge)
        penalty[-1] = 1e-6
        hess = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty[free])
        step = np.linalg.solve(hess, x[:, free].T @ (y - p) - penalty[free] * beta[free])
        beta[free] += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            if not (low := free[:-1] & (beta[:-1] < 0)).any():
                break
            free[:-1] &= ~low
            beta[:-1][low] = 0
    return tuple(float(b) for b in beta[:-1]), float(beta[-1])


def fit(rows: list[tuple[str | None, int]], bounds: Bounds = Bounds()) -> Model:
    """A model from (text, label) rows, in their order."""
    sides = [[t for t, y in rows if y == label] for label in (0, 1)]
    if min(map(len, sides)) < 3:
        return Model(b"", b"", (), (), len(sides[1]) / len(rows) if rows else 0.0)
    learn = [[plain(t) for i, t in enumerate(s) if i % 3] for s in sides]
    model = Model(dictionary(learn[1], learn[0], bounds.dictionary), dictionary(learn[0], learn[1], bounds.dictionary), (), (0.0,), 0.0)
    scorer = Scorer(model)
    rest = [[scorer.gains(t) for i, t in enumerate(s) if i % 3 == 0] for s in sides]
    levels = _levels(sum(rest[1]), sum(rest[0]))
    scorer = Scorer(Model(model.toxic, model.ordinary, levels, (0.0,), 0.0))
    x, y = [scorer.features(g) for side in rest for g in side], [float(k) for k, side in enumerate(rest) for _ in side]
    return Model(model.toxic, model.ordinary, levels, *_logistic(np.array(x), np.array(y)))


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on a bounded sample, in the order of a hash, of the labelled rows outside fold 0."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    usable = docs.filter((fold(F.col("doc_id")) != 0) & (F.octet_length(F.coalesce("text", F.lit(""))) <= bounds.bytes_each)).select("doc_id").distinct()
    order = [F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.col("doc_id")]
    both = known.join(usable, "doc_id", "left_semi")
    picked = materialize(both.filter("toxic = 1").orderBy(*order).limit(bounds.toxic).unionByName(both.filter("toxic = 0").orderBy(*order).limit(bounds.ordinary)), "toxicity")
    # At most bounds.toxic + bounds.ordinary ids are broadcast, and as many texts of bounded length come to the driver.
    taken = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= bounds.bytes_each).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    taken = taken.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(taken.collect(), key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit([(r["text"], r["toxic"]) for r in rows], bounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, columns unchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = docs.columns.index("text")
    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            clean = pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.filter(clean).columns, schema=schema)

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
