"""Byte-level BPE by Aho-Corasick matches and backtracking.

The vocabulary's byte strings, mapped to Latin-1, form one pyahocorasick automaton. For each piece of text
(one match of the splitting pattern) the automaton gives the longest token at every offset; the encoder walks
from longest matches, keeps a token only if BPE could leave it beside its left neighbour (memoised for each
pair), and otherwise tries the token's longest proper prefix or steps back. Offsets found to be dead ends are
not entered twice, so the time is linear in the piece, and the result equals that of the merges.

Edge cases: a null or empty text has no tokens; rows are independent, so repeated rows and ties give equal
results; very long pieces need no recursion; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querent.runtime import bounded_batches, table

#: Unicode's White_Space characters, as in the splitting pattern's \s.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A piece never crosses these chunks: a single space joins what follows, other white space stands alone.
CHUNK = f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Entries that a worker's table of encoded chunks holds before it starts anew.
CACHED = 100_000
#: And of pairs of tokens whose compatibility is known.
PAIRS = 400_000


def default_vocabulary() -> tuple[str, str]:
    """(path of the rank file, splitting pattern) of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_pattern() -> str:
    """The pattern whose pieces of letters are known to be whole chunks."""
    return default_vocabulary()[1]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, rank_path: str, pattern: str):
        import ahocorasick
        import regex

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), i))
        self.matches.make_automaton()
        self.halves = {i: self._split(t, i) for t, i in ranks.items()}
        self.merged = {pair: i for i, pair in self.halves.items() if pair[1] >= 0}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.plain = pattern == public_pattern()
        self.known = _Cache(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())

    def _split(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (rank, -1) for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            at = min(range(len(joined)), key=joined.__getitem__)
            if joined[at] >= rank:
                raise ValueError(f"token {rank} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (rank, -1) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]])

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.bytes_of[token]
            found = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side.

        The merges are undone from the latest: at each step the pair that touches at the border must not be
        one that would have been merged earlier than the step undone. Of equal ranks the left merge is first.
        """
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is not None:
            return known
        a, b, bound, good = left, right, 1 << 40, True
        while True:
            if self.merged.get((a, b), bound) < bound:
                good = False
                break
            from_left = self.halves[a] if self.halves[a][1] >= 0 else None
            from_right = self.halves[b] if self.halves[b][1] >= 0 else None
            if from_left and (a > b or not from_right):
                bound, a = a, from_left[1]
            elif from_right:
                bound, b = b + 1, from_right[0]
            else:
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[pair] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        reach = [0] * len(piece)
        for end, (n, token) in self.matches.iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > reach[start]:
                reach[start], longest[start] = n, token
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while True:
                end = at + len(self.bytes_of[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < len(piece):
                        token = longest[at]
                    break
                token = self.prefix(token)
                if token < 0:  # nothing fits here: step back and try a shorter token before
                    dead[at] = 1
                    token = out.pop()
                    at -= len(self.bytes_of[token])
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids of a chunk as little-endian unsigned 32-bit integers."""
        if self.plain and (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # an optional space and letters are one piece
            return array("I", self.encode_piece(chunk.encode())).tobytes()
        return b"".join([self.known[piece] for piece in self.pieces(chunk)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class _Cache(dict):
    """Encoded strings. Where it is full it starts anew, but takes what is asked for again from the one before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, string: str) -> bytes:
        if len(self) >= CACHED:
            self.before = dict(self)
            self.clear()
        found = self.before.get(string)
        if found is None:
            found = self.make(string)
        if len(string) < 64:
            self[string] = found
        return found


class Encoder:
    """``Bpe`` with a bounded table of encoded chunks."""

    _own: dict[tuple[str, str], Encoder] = {}

    def __init__(self, rank_path: str, pattern: str):
        import re

        self.bpe = Bpe(rank_path, pattern)
        self.known = _Cache(self.bpe.encode_chunk)
        self.chunks = re.compile(CHUNK).findall
        self.decode = self.bpe.decode

    @classmethod
    def of(cls, rank_path: str, pattern: str) -> Encoder:
        """This process's encoder; workers are reused by later tasks."""
        if (rank_path, pattern) not in cls._own:
            cls._own[rank_path, pattern] = cls(rank_path, pattern)
        return cls._own[rank_path, pattern]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.chunks(text)))


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(rank_path, pattern)
        for batch in batches:
            ids = [own.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of ``encode``'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(rank_path, pattern)
        for batch in batches:
            texts = [own.decode(x.as_py()).decode() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return bounded_batches(encoded.select("doc_id", "ids")).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, decodes its ids, digests both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(rank_path, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for x in batch.column(1):
                ids = own.encode(x.as_py() or "")
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
