"""LM scoring with a sharded Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting, interpolated with add-half unigrams:
    P(w | v) = max(c(v, w) - D, 0) / c(v) + D * n(v) / c(v) * P(w),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
c: training counts, n(v): distinct successors of v; P(w | v) = P(w) for a context never seen.

Counts of the whole training part are too many for one machine, so contexts are dealt over shards by their hash, and
the few contexts that are more frequent than a shard should hold are dealt by context and word. Documents stay
where they are: a group of documents (a few MB) sends each shard one packed message with the contexts and
successors it holds and their training counts. A shard adds the messages up, builds its trie, queries it for every
context and successor in the messages, and answers each group with one packed message. The group then scores its
texts. Messages hold each distinct n-gram of a group once; nothing is sent for each token, and nothing is broadcast
but the list of frequent contexts, which the number of shards bounds.

A trie has two levels in one contiguous buffer that can be mapped from a file or, as here, lies in anonymous mapped
memory: contexts and successor words as sorted hashes, Elias-Fano coded; monotone pointers, Elias-Fano coded, from
contexts to intervals of the second level; successors within their context as context * words + word, which is
monotone over the level and Elias-Fano coded; and 16-bit codes of log10 of the discounted probability. A query finds
its context, reads from the pointers where its successors begin and end, and looks for the word relative to the context between
them alone.

Words are known by 64-bit hashes, successors of a context by 40 bits.

Edge cases: null and empty texts have the end token alone; a null id is hashed as the empty string (training part);
rows with equal ids are scored and counted each; without training documents N = V = 0 and the
formulas give probability 1; very long texts make a group of their own; an empty table gives no rows.
``docs`` has to be a stored table, as it is read twice and has to come in the same partitions; this is checked.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.runtime import bounded_batches, materialize, table

DISCOUNT = 0.9
GROUP_BYTES = 8 << 20
SHARD_TOKENS = 500_000
FREQUENT = 4  # a context with more than 1 / (FREQUENT * shards) of all tokens is dealt by context and word
STEP = 65535 / 12.0  # codes a decade: codes reach from 1e-12 to 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# The trie --------------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with a count of ones before every 512 bits."""

    def __init__(self, buffer: np.ndarray, n: int, low_bits: int, high_words: int):
        self.n, self.low_bits = n, low_bits
        low_words = (n * low_bits + 63) // 64 + 1
        self.low, self.high, self.ones = buffer[:low_words], buffer[low_words : low_words + high_words], buffer[low_words + high_words :]

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> tuple[np.ndarray, tuple[int, int, int]]:
        """(words, shape) for sorted uint64 values below ``universe``."""
        n = len(values)
        bits = max(0, int(math.log2(max(1, universe // max(1, n)))))
        low_words = (n * bits + 63) // 64 + 1
        low = np.zeros(low_words, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        blocks = (int(high[-1]) + 1 if n else 0) // 512 + 1  # at least one zero behind the last one
        flags = np.zeros(512 * blocks, np.uint8)
        flags[high] = 1
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(axis=1))]).astype(np.uint64)
        return np.concatenate([low, words, before]), (n, bits, len(words))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        both = self.low[word] >> shift
        over = shift > 0
        both[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return both & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros among the high bits."""
        counts = self.ones.astype(np.int64)
        if not ones:
            counts = 512 * np.arange(len(counts)) - counts
        block = np.searchsorted(counts, k, side="right") - 1
        left = k - counts[block]
        word = block * 8
        for _ in range(8):  # at most eight words a block
            here = np.bitwise_count(self.high[np.minimum(word, len(self.high) - 1)]).astype(np.int64)
            here = here if ones else 64 - here
            go = left >= here
            if not go.any():
                break
            left, word = np.where(go, left - here, left), np.where(go, word + 1, word)
        x = self.high[np.minimum(word, len(self.high) - 1)]
        x = x if ones else ~x
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= low
            left, at = np.where(go, left - low, left), np.where(go, at + width, at)
            x = np.where(go, x >> np.uint64(width), x)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The positions of values, -1 where absent: the bucket of the high bits is walked by low bits, and only from ``low`` on
        and below ``high``, if given."""
        if not self.n:
            return np.full(len(values), -1)
        bucket = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = 64 * len(self.high) - self.n
        inside = bucket < zeros
        bucket = np.minimum(bucket, zeros - 1)
        start = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) - bucket + 1, 0)
        end = np.minimum(self._select(bucket, False) - bucket, self.n)
        if low is not None:
            start, end = np.maximum(start, low), np.minimum(end, high)
        want, found = values & np.uint64((1 << self.low_bits) - 1), np.full(len(values), -1)
        open_ = np.nonzero(inside & (start < end))[0]
        at = start[open_]
        while len(open_):
            here = self._low(at)
            found[open_[here == want[open_]]] = at[here == want[open_]]
            more = (here < want[open_]) & (at + 1 < end[open_])
            open_, at = open_[more], at[more] + 1
        return found


class Trie:
    """Contexts, successors and quantised probabilities; built from sorted unique pairs (context, word)."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, logs: np.ndarray):
        """contexts: uint64, words: below 2**40, ordered by (context, word); logs: log10 probabilities."""
        self.codes = 1 + np.clip(np.floor((logs + 12) * STEP), 0, 65534).astype(np.uint16) if len(logs) else np.zeros(0, np.uint16)
        names, starts = np.unique(contexts, return_index=True)
        vocabulary, rank = np.unique(words, return_inverse=True)
        owner = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(contexts))))
        self.width = max(1, len(vocabulary))
        levels = [(names >> np.uint64(1), 1 << 63), (vocabulary, 1 << 40), (np.append(starts, len(contexts)).astype(np.uint64), len(contexts) + 1), (owner.astype(np.uint64) * np.uint64(self.width) + rank.astype(np.uint64), max(1, len(names)) * self.width)]
        packed = [EliasFano.pack(np.asarray(v, np.uint64), u) for v, u in levels]
        size = sum(len(w) for w, _ in packed)
        self.memory = mmap.mmap(-1, max(8, 8 * size))
        buffer, at, self.levels = np.frombuffer(self.memory, np.uint64), 0, []
        for words_, shape in packed:
            buffer[at : at + len(words_)] = words_
            self.levels.append(EliasFano(buffer[at : at + len(words_)], *shape))
            at += len(words_)

    def codes_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The codes of pairs; 0 for those that aren't there. Contexts are told apart by their upper 63 bits."""
        names, vocabulary, pointers, successors = self.levels
        c, w = names.find(contexts >> np.uint64(1)), vocabulary.find(words)
        out = np.zeros(len(contexts), np.uint16)
        some = np.nonzero((c >= 0) & (w >= 0))[0]
        begin, end = pointers.get(c[some]).astype(np.int64), pointers.get(c[some] + 1).astype(np.int64)
        at = successors.find(c[some].astype(np.uint64) * np.uint64(self.width) + w[some].astype(np.uint64), begin, end)
        out[some[at >= 0]] = self.codes[at[at >= 0]]
        return out


def probabilities(codes: np.ndarray) -> np.ndarray:
    """Probabilities from codes, rounded down; 0 for code 0."""
    table_ = np.concatenate([[0.0], 10.0 ** (np.arange(65535) / STEP - 12)])
    return table_[codes]


# Groups of documents ---------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxh64_intdigest(word) & ~1  # the lowest bit is left free
        return found


END, BEGIN = b"", b" "  # no words
_KNOWN = _Words()  # of this process; workers are reused by later tasks


def _hashed(text: str | None) -> np.ndarray:
    """The hashes of a text's start, words and end."""
    words = [BEGIN, *(text or "").encode().lower().split(), END]
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 1


class Group:
    """The distinct words and bigrams of some texts, in the order of their hashes, with training counts."""

    def __init__(self, texts: list[str | None], train: np.ndarray):
        parts = [_hashed(t) for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.begin = np.uint64(_KNOWN[BEGIN])
        self.words, at = np.unique(every, return_inverse=True)
        last = np.cumsum(lengths) - 1
        keep = np.ones(len(every), bool)
        keep[last] = False  # what starts a bigram
        self.previous = at[keep]
        keep[last], keep[last - lengths + 1] = True, False
        self.current = at[keep]
        self.tokens = lengths - 1
        weight = np.repeat(np.asarray(train, np.int64), self.tokens)
        self.counts = np.bincount(self.current, weight, len(self.words)).astype(np.int64)
        started = np.bincount(self.previous, weight, len(self.words)).astype(np.int64)
        self.starts = int(started[self.words == self.begin].sum())
        keys, self.bigram = np.unique(self.previous * max(1, len(self.words)) + self.current, return_inverse=True)
        self.first, self.second = np.divmod(keys, max(1, len(self.words)))
        self.pairs = np.bincount(self.bigram, weight, len(keys)).astype(np.int64)
        self.short = self.words >> np.uint64(24)

    def dealt(self, shards: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: the words it is home to or gets bigrams of, and its bigrams, as indexes in order."""
        home = (_mixed(self.words) % np.uint64(shards)).astype(np.int64)
        spread = np.isin(self.words, frequent)[self.first]
        place = np.where(spread, (_mixed(self.words[self.first] * _A + self.words[self.second]) % np.uint64(shards)).astype(np.int64), home[self.first])
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(shards + 1))
        homes = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[homes], np.arange(shards + 1))
        for s in range(shards):
            pairs, own = order[edges[s] : edges[s + 1]], homes[bounds[s] : bounds[s + 1]]
            if len(pairs) or len(own):
                yield s, np.union1d(own, self.first[pairs]), pairs


def _message(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _opened(message: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(message)
    sizes = np.frombuffer(data, "<i8", len(kinds), 8).tolist()
    out, at = [], 8 * (len(kinds) + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _five(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**40 as five bytes each, by significance."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((raw.size // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(5, -1).T
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.copy()  # planes of bytes, most of them zero


def _from_small(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of successive groups of a partition; the same for the same partition whatever the batches."""
    from pyspark import TaskContext

    number, size, held = TaskContext.get().partitionId() << 24, 0, []
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        start, total = 0, np.cumsum(lengths)
        while start < batch.num_rows:
            taken = int(total[start - 1]) if start else 0
            stop = int(np.searchsorted(total, GROUP_BYTES - size + taken)) + 1
            if stop > batch.num_rows:
                held.append(batch.slice(start))
                size += int(total[-1]) - taken
                break
            held.append(batch.slice(start, stop - start))
            yield number, pa.Table.from_batches(held)
            number, size, held, start = number + 1, 0, [], stop
    if held:
        yield number, pa.Table.from_batches(held)


# Spark -----------------------------------------------------------------------------------------------------


def unigrams(docs: DataFrame) -> DataFrame:
    """(word hash, count) over the training part, end tokens included, and text starts as a word of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            words, counts = np.unique(np.concatenate([_hashed(t) for t in rows.column("text").to_pylist()]), return_counts=True)
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    found = docs.filter(training(F.col("doc_id"))).select("text").mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    begin = int(np.array(_KNOWN[BEGIN], np.uint64).view(np.int64))
    counted = materialize(unigrams(docs), "lm-words")
    row = counted.filter(F.col("word") != begin).agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = row[0] or 0, row[1]
    shards = max(1, tokens // shard_tokens)
    # At most FREQUENT * shards words (and the text start) are frequent enough.
    heavy = {int(r["word"]) & (2**64 - 1): int(r["n"]) for r in counted.filter(F.col("n") * (FREQUENT * shards) > tokens).collect()}
    frequent = np.array(sorted(heavy), np.uint64)
    total = np.array([heavy[int(w)] for w in frequent], np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", training(F.col("doc_id")).alias("train"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches):
            g = Group(rows.column("text").to_pylist(), rows.column("train").to_numpy())
            out = [[], [], []]
            counts = g.counts.copy()
            counts[g.words == g.begin] = g.starts
            for s, own, pairs in g.dealt(shards, frequent):
                at = np.searchsorted(own, g.first[pairs])
                message = _message(g.words[own], _small(counts[own]), _small(np.bincount(at, minlength=len(own))), _five(g.short[g.second[pairs]]), _small(g.pairs[pairs]))
                for column, v in zip(out, (s, number, message), strict=True):
                    column.append(v)
                if len(out[0]) >= 256:
                    yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["shard", "grp", "message"])
                    out = [[], [], []]
            if out[0]:
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["shard", "grp", "message"])

    def answer(rows: pa.Table) -> pa.Table:
        groups, shard = rows.column("grp").to_pylist(), rows.column("shard")[0].as_py()
        opened = [_opened(m.as_py(), "<u8", "u1", "u1", "u1", "u1") for m in rows.column("message")]
        words = np.concatenate([o[0] for o in opened])
        names, at = np.unique(words, return_inverse=True)
        counts = np.bincount(at, np.concatenate([_from_small(o[1]) for o in opened]), len(names)).astype(np.int64)
        spread = np.isin(names, frequent)
        home = (_mixed(names) % np.uint64(shards)).astype(np.int64) == shard
        context = counts.copy()
        if spread.any():
            context[spread] = total[np.searchsorted(frequent, names[spread])]
        owner = np.repeat(at, np.concatenate([_from_small(o[2]) for o in opened]))
        second = np.concatenate([_from_five(o[3]) for o in opened])
        keys, back = np.unique(owner.astype(np.uint64) << np.uint64(40) | second, return_inverse=True)
        pairs = np.bincount(back, np.concatenate([_from_small(o[4]) for o in opened]), len(keys))
        first, last = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)
        seen = pairs > 0
        logs = np.log10(np.maximum(pairs[seen] - discount, 1e-9) / context[first[seen]])
        trie = Trie(names[first[seen]], last[seen], logs)
        codes = trie.codes_of(names[first], last)
        successors = np.bincount(first[seen], minlength=len(names))
        # The end token is no context; its count is home here like that of any other word.
        out, place, spot = [], 0, 0
        for o in opened:
            own, n = at[place : place + len(o[0])], len(o[3]) // 5
            out.append(_message(_small(np.where(home[own], counts[own], 0)), _small(np.where(spread[own], 0, successors[own])), codes[back[spot : spot + n]]))
            place, spot = place + len(o[0]), spot + n
        partial = [names[spread].view(np.int64).tolist(), successors[spread].tolist()]
        empty = [[]] * (len(groups) - 1)
        return pa.table([pa.array([shard] * len(groups), pa.int32()), pa.array(groups, pa.int64()), pa.array(out, pa.binary()), pa.array([partial[0], *empty], pa.list_(pa.int64())), pa.array([partial[1], *empty], pa.list_(pa.int64()))], names=["shard", "grp", "answer", "word", "successors"])

    sent = bounded_batches(source).mapInArrow(send, "shard int, grp long, message binary")
    answers = materialize(sent.groupBy("shard").applyInArrow(answer, "shard int, grp long, answer binary, word array<long>, successors array<long>"), "lm-answers")
    parts = answers.select(F.explode(F.arrays_zip("word", "successors")).alias("x")).groupBy("x.word").agg(F.sum("x.successors").alias("n")).collect()
    joint = {int(r["word"]) & (2**64 - 1): int(r["n"]) for r in parts}
    heavy_successors = np.array([joint.get(int(w), 0) for w in frequent], np.int64)
    below = tokens + 0.5 * (kinds + 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, rows in _grouped(batches):
            for batch in rows.append_column("grp", pa.array(np.full(rows.num_rows, grp))).to_batches():
                yield batch

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        g = Group(rows.column("text").to_pylist(), rows.column("train").to_numpy())
        counts, successors, codes = np.zeros(len(g.words), np.int64), np.zeros(len(g.words), np.int64), np.zeros(len(g.first), np.uint16)
        by_shard = dict(zip(replies.column("shard").to_pylist(), replies.column("answer"), strict=True))
        for s, own, pairs in g.dealt(shards, frequent):
            if s not in by_shard:
                raise RuntimeError("the documents came in other partitions than before; store the table first")
            n, distinct, code = _opened(by_shard[s].as_py(), "u1", "u1", "<u2")
            if len(code) != len(pairs) or len(n) != 8 * len(own):
                raise RuntimeError("the documents came in other partitions than before; store the table first")
            counts[own] += _from_small(n)
            successors[own] += _from_small(distinct)
            codes[pairs] = code
        context = counts.copy()
        hot = np.isin(g.words, frequent)
        if hot.any():
            successors[hot] = heavy_successors[np.searchsorted(frequent, g.words[hot])]
        single = (counts + 0.5) / below
        known = context > 0
        back = np.where(known, discount * successors / np.maximum(context, 1), 1.0)
        p = probabilities(codes[g.bigram]) + back[g.previous] * single[g.current]
        edges = np.concatenate([[0], np.cumsum(g.tokens)[:-1]]).astype(np.int64)
        summed = [np.add.reduceat(v, edges) for v in (np.log10(single[g.current]), np.log10(p), (counts[g.current] > 0).astype(np.int64))]
        held = ~rows.column("train").to_numpy()
        return pa.table([rows.column("doc_id"), pa.array(held), pa.array(g.tokens), pa.array(summed[2]), pa.array(np.full(len(held), tokens)), pa.array(summed[0]), pa.array(summed[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    numbered = bounded_batches(source).mapInArrow(number, f"doc_id {kind}, text string, train boolean, grp long")
    replies = answers.select("grp", "shard", "answer")
    both = numbered.groupBy("grp").cogroup(replies.groupBy("grp"))
    return both.applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score(table(spark, sf_dir, "documents"))
