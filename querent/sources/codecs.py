"""Integer codecs of id lists: variable bytes, gaps, bit packing, and sets of ids; as functions and over columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.errors import InvalidParameter

BLOCK = 128


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first, the top bit set on all but the last byte."""
    if n < 0:
        raise InvalidParameter("only numbers from 0")
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, offset behind it)."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise InvalidParameter("a number is cut off or too long")
        n |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return n, at


def gaps(values: list[int]) -> list[int]:
    """The first value, then differences."""
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def ungap(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def gap_column(values: str | Column) -> Column:
    """``gaps`` on an array column."""
    v = F.col(values) if isinstance(values, str) else values
    return F.transform(v, lambda x, i: x - F.when(i > 0, F.get(v, i - 1)).otherwise(0))


def bit_width(values: list[int]) -> int:
    return max((v.bit_length() for v in values), default=0)


def pack(values: list[int], width: int) -> bytes:
    """Numbers of ``width`` bits each, the first in the lowest bits."""
    whole = 0
    for i, v in enumerate(values):
        if v >> width:
            raise InvalidParameter(f"{v} has more than {width} bits")
        whole |= v << (i * width)
    return whole.to_bytes((len(values) * width + 7) // 8, "little")


def unpack(data: bytes, width: int, count: int) -> list[int]:
    whole = int.from_bytes(data, "little")
    return [(whole >> (i * width)) & ((1 << width) - 1) for i in range(count)]


def compress_set(ids: list[int], universe: int) -> bytes:
    """Sorted distinct ids below ``universe`` as count, first and gaps, in variable bytes."""
    if any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
        raise InvalidParameter("ids must be sorted and distinct")
    if ids and (ids[0] < 0 or ids[-1] >= universe):
        raise InvalidParameter("an id is outside the universe")
    return varint(len(ids)) + b"".join(map(varint, gaps(ids)))


def decompress_set(data: bytes, universe: int) -> list[int]:
    n, at = read_varint(data)
    steps = []
    for _ in range(n):
        v, at = read_varint(data, at)
        steps.append(v)
    ids = ungap(steps)
    if at != len(data) or (ids and ids[-1] >= universe):
        raise InvalidParameter("the set is damaged")
    return ids


def bits_per_id(count: int, universe: int) -> float:
    """What an id costs at best, about: log2 of the universe over the count."""
    return math.log2(universe / count) if 0 < count < universe else 0.0


def _checked(ids: list[int], universe: int) -> list[int]:
    if any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or ids and (ids[0] < 0 or ids[-1] >= universe):
        raise InvalidParameter("ids must be sorted, distinct and below the universe")
    return ids


def elias_fano(ids: list[int], universe: int) -> bytes:
    """Count, then low bits packed and high bits in unary: about 2 + log2(universe / count) bits an id."""
    n = len(_checked(ids, universe))
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    high = sum(1 << ((v >> low) + i) for i, v in enumerate(ids))
    return varint(n) + pack([v & ((1 << low) - 1) for v in ids], low) + high.to_bytes((high.bit_length() + 7) // 8, "little")


def from_elias_fano(data: bytes, universe: int) -> list[int]:
    n, at = read_varint(data)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    size = (n * low + 7) // 8
    lows, high, out, place = unpack(data[at : at + size], low, n), int.from_bytes(data[at + size :], "little"), [], 0
    while high and len(out) < n:
        step = (high & -high).bit_length() - 1  # zeros up to the next one
        high >>= step + 1
        place += step
        out.append(place << low | lows[len(out)])
    if len(out) != n or high:
        raise InvalidParameter("the set is damaged")
    return out


def wavelet(ids: list[int], universe: int) -> bytes:
    """Count, then a wavelet matrix: for each bit from the highest the ids' bits, ids with a zero moving before those with a one."""
    width, rows, out = max(1, (universe - 1).bit_length()), list(_checked(ids, universe)), []
    for level in range(width - 1, -1, -1):
        bits = [v >> level & 1 for v in rows]
        out.append(pack(bits, 1))
        rows = [v for v, b in zip(rows, bits, strict=True) if not b] + [v for v, b in zip(rows, bits, strict=True) if b]
    return varint(len(ids)) + b"".join(out)


def from_wavelet(data: bytes, universe: int) -> list[int]:
    n, at = read_varint(data)
    width, size = max(1, (universe - 1).bit_length()), (n + 7) // 8
    if len(data) != at + width * size:
        raise InvalidParameter("the set is damaged")
    place, values = list(range(n)), [0] * n
    for level in range(width):
        bits = unpack(data[at + level * size : at + (level + 1) * size], 1, n)
        zeros = n - sum(bits)
        ones = [0, *accumulate(bits)]
        for i, p in enumerate(place):
            values[i] = values[i] << 1 | bits[p]
            place[i] = zeros + ones[p] if bits[p] else p - ones[p]
    return values


#: Ways to write a set of ids: (writer, reader).
METHODS = {
    "none": (lambda ids, universe: b"".join(v.to_bytes(8, "little") for v in _checked(ids, universe)), lambda data, universe: [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]),
    "gaps": (compress_set, decompress_set),
    "elias_fano": (elias_fano, from_elias_fano),
    "wavelet": (wavelet, from_wavelet),
}


class UniformCoder:
    """Symbols of equal probability as digits of one number."""

    def __init__(self, alphabet: int):
        if alphabet < 1:
            raise InvalidParameter("the alphabet is empty")
        self.alphabet = alphabet

    def encode(self, symbols: list[int]) -> bytes:
        state = 1
        for s in symbols:
            if not 0 <= s < self.alphabet:
                raise InvalidParameter(f"{s} is not in the alphabet")
            state = state * self.alphabet + s
        return state.to_bytes((state.bit_length() + 7) // 8, "big")

    def decode(self, data: bytes) -> list[int]:
        state, out = int.from_bytes(data, "big"), []
        while state > 1 and self.alphabet > 1:
            state, s = divmod(state, self.alphabet)
            out.append(s)
        return out[::-1]


def compressed(sets: DataFrame, universe: int, method: str = "gaps") -> DataFrame:
    """(key, data) of (key, ids array): each sorted set written by one of ``METHODS``, in batches."""
    if method not in METHODS:
        raise InvalidParameter(f"unknown method {method}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "data": [METHODS[method][0](list(map(int, v)), universe) for v in f["ids"]]})

    return sets.select("key", F.array_sort(F.array_distinct("ids")).alias("ids")).mapInPandas(run, f"key {sets.schema['key'].dataType.simpleString()}, data binary")


def decompressed(rows: DataFrame, universe: int, method: str = "gaps") -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "ids": [METHODS[method][1](bytes(v), universe) for v in f["data"]]})

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<long>")
