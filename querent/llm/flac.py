"""FLAC media columns: encoding, decoding and checking of 8-bit mono streams, many frames at a time.

The encoder cuts a stream into frames of 576 samples and writes each as a constant, verbatim, fixed-predictor or
linear-predictor subframe, whichever is smallest, residuals Rice-coded with a parameter for each partition. Every
frame gets a seek point. The decoder finds frames by the seek table (or by sync codes, frame numbers and header
checksums where there is none), checks the header's CRC-8, the frame's CRC-16, the frames' lengths and the
stream's MD5, and yields PCM blocks with their sample offsets; ``seek`` decodes the frames alone that hold the samples
asked for. The query stores the streams in the shared folder and reads them back. Frames are worked on in lockstep: one numpy step
decodes the i-th sample of thousands of frames, each at its own bit position.

Edge cases: a null or empty text is one frame of padding; equal texts give equal streams whatever stands beside
them; long texts are worked on in slices of frames, so memory is bounded by one text and one slice; rows are
independent; an empty table gives no rows; further columns are ignored. Damaged streams raise ``FlacError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querent.runtime import bounded_batches, materialize, table

BLOCK = 576
PARTS = 4  # highest partition order that the encoder tries
PARAMS = 8  # Rice parameters that the encoder tries
ORDER, PRECISION = 6, 12  # of the encoder's linear predictor
SLICE = 4096  # frames worked on at once
RATE = 8000
TAIL = 32  # samples that the query seeks
STORED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream is damaged or uses what this decoder doesn't know."""


# Checksums ------------------------------------------------------------------------------------------------


@cache
def _table(bits: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = ((v << 1) ^ polynomial if v & top else v << 1) & mask
        out.append(v)
    return np.array(out, np.uint16)


@cache
def _pairs() -> np.ndarray:
    """CRC-16 of two bytes."""
    one = _table(16, 0x8005)
    first = one[np.arange(65536) >> 8]
    return one[(first >> 8) ^ (np.arange(65536) & 255).astype(np.uint16)] ^ (first << 8)


def crc8(data: bytes) -> int:
    steps, crc = _table(8, 0x07), 0
    for b in data:
        crc = int(steps[crc ^ b])
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[starts[i]:ends[i]] for all i at once. Zeros before a frame don't change a CRC of zero."""
    length = int((ends - starts).max(initial=0))
    length += length & 1
    crc, steps = np.zeros(len(starts), np.uint16), _pairs()
    padded = np.concatenate([np.zeros(length, np.uint8), data]).astype(np.uint16)
    skip = length - (ends - starts)  # zeros before the frame
    for i in range(0, length, 2):
        a, b = padded[ends + i], padded[ends + i + 1]
        if i <= skip.max(initial=0):
            a, b = a * (i >= skip), b * (i + 1 >= skip)
        crc = steps[crc ^ ((a << 8) | b)]
    return crc


@cache
def _coded(number: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if number < 0x80:
        return bytes([number])
    n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
    lead = (0xFF00 >> n) & 0xFF
    tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(n - 2, -1, -1)]
    return bytes([lead | number >> (6 * (n - 1)), *tail])


def _head(number: int) -> bytes:
    head = b"\xff\xf8\x24\x02" + _coded(number)
    return head + bytes([crc8(head)])


_head_small = cache(_head)


# Encoding -------------------------------------------------------------------------------------------------


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, ORDER) and shifts of a linear predictor for each frame."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : BLOCK - lag]).sum(1) for lag in range(ORDER + 1)], 1)
    a, err = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    shift = np.clip(PRECISION - 1 - np.frexp(np.abs(a).max(1))[1], 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int32), shift.astype(np.int32)


def _encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of samples x (frames, 576), int32."""
    n = len(x)
    fixed = [x]
    for order in range(1, 5):
        e = np.zeros_like(x)
        e[:, order:] = np.diff(fixed[-1][:, order - 1 :], axis=1)
        fixed.append(e)
    size = np.stack([np.abs(e[:, 4:]).sum(1) for e in fixed], 1)
    order = size.argmin(1)
    res = np.choose(order[:, None], fixed)
    coef, shift = _predictor(x)
    guess = sum((coef[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)), np.zeros((1, 1), np.int32)) >> shift[:, None]
    linear = x[:, ORDER:] - guess
    # A bit saved a sample pays for the coefficients.
    gain = np.log2(size.min(1) + 1.0) - np.log2(np.abs(linear).sum(1) + 1.0)
    lpc = gain * BLOCK > ORDER * (PRECISION + 8)
    res[lpc] = 0
    res[np.ix_(lpc, range(ORDER, BLOCK))] = linear[lpc]
    order = np.where(lpc, ORDER, order)
    inside = np.arange(BLOCK) >= order[:, None]
    u = np.where(inside, _zigzag(res), 0)

    # Rice parameters: sums of quotients by smallest partition, then joined for lower partition orders.
    least = BLOCK >> PARTS
    quotients = np.stack([(u >> k).reshape(n, 1 << PARTS, least).sum(2) for k in range(PARAMS)], 2)
    counts = inside.reshape(n, 1 << PARTS, least).sum(2)
    best, params, parts = np.full(n, 1 << 30), np.zeros((n, 1 << PARTS), np.int32), np.zeros(n, np.int32)
    for p in range(PARTS, -1, -1):
        if p < PARTS:
            quotients, counts = quotients[:, ::2] + quotients[:, 1::2], counts[:, ::2] + counts[:, 1::2]
        bits = quotients + counts[:, :, None] * (np.arange(PARAMS) + 1)
        total = bits.min(2).sum(1) + 4 * (1 << p)
        better = total < best
        best, parts = np.where(better, total, best), np.where(better, p, parts)
        params = np.where(better[:, None], np.repeat(bits.argmin(2), 1 << (PARTS - p), axis=1), params)
    extra = np.where(lpc, 9 + ORDER * PRECISION, 0)
    best += 6 + 8 * order + extra
    constant = (x == x[:, :1]).all(1)
    raw = ~constant & (best >= 8 * BLOCK)
    rice = ~constant & ~raw

    heads = [_head_small(i) if i < 4096 else _head(i) for i in numbers.tolist()]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    body = np.where(constant, 1, np.where(raw, BLOCK, (best + 7) // 8))
    lengths = head_len + 1 + body + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ends, starts = starts[1:], starts[:-1]
    bits = np.zeros(8 * int(lengths.sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = (values >> (width - 1 - j)) & 1

    at = 8 * (starts + head_len)
    put(at, np.where(constant, 0, np.where(raw, 2, np.where(lpc, 0x40 | (ORDER - 1) << 1, 0x10 | order << 1))), 8)
    at = at + 8
    put(at[constant], x[constant, 0] & 255, 8)
    if raw.any():
        put(at[raw][:, None] + 8 * np.arange(BLOCK), x[raw] & 255, 8)
    for j in range(max(4, ORDER)):
        warm = rice & (order > j)
        put(at[warm] + 8 * j, x[warm, j] & 255, 8)
    at = at + 8 * order
    line = rice & lpc
    put(at[line], np.full(line.sum(), PRECISION - 1), 4)
    put(at[line] + 4, shift[line], 5)
    for j in range(ORDER):
        put(at[line] + 9 + PRECISION * j, coef[line, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + extra
    put(at[rice] + 2, parts[rice], 4)
    at = at[rice] + 6
    k = np.repeat(params[rice], least, axis=1)
    u, inside, parts = u[rice], inside[rice], parts[rice]
    width = np.where(inside, (u >> k) + 1 + k, 0)
    opens = np.arange(BLOCK) % (BLOCK >> parts)[:, None] == 0
    offset = np.cumsum(width + 4 * opens, axis=1) - width + at[:, None]  # a partition's parameter stands before its first sample
    row, col = np.nonzero(opens)
    put((offset - 4)[row, col], k[row, col], 4)
    offset, u, k = offset[inside], u[inside], k[inside]
    stop = offset + (u >> k)
    bits[stop] = 1
    for j in range(int(k.max(initial=0))):
        some = k > j
        bits[stop[some] + k[some] - j] = (u[some] >> j) & 1
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        s = starts[i]
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = sums >> 8, sums & 255
    raw_bytes = data.tobytes()
    return [raw_bytes[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _stream(payload: bytes, samples: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    md5 = hashlib.md5(samples).digest()
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    points = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
    points["sample"], points["offset"], points["samples"] = np.arange(len(frames)) * BLOCK, np.cumsum([0, *sizes[:-1]]), BLOCK
    seek = points.tobytes()
    blocks = b"\x00" + len(info).to_bytes(3, "big") + info
    if len(seek) < 1 << 24:
        blocks += b"\x83" + len(seek).to_bytes(3, "big") + seek
    else:  # too many points for a block; the decoder then finds frames by their headers
        blocks = b"\x80" + blocks[1:]
    return b"fLaC" + blocks + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of 576 bytes; a byte b is the sample b - 128."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for i in range(0, len(whole), SLICE):
        frames += _encode_frames(whole[i : i + SLICE].astype(np.int32) - 128, numbers[i : i + SLICE])
    out, at = [], 0
    flipped = (whole ^ 128).tobytes()
    for p, c in zip(payloads, counts, strict=True):
        out.append(_stream(p, flipped[at * BLOCK : (at + c) * BLOCK], frames[at : at + c]))
        at += c
    return out


# Decoding -------------------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise FlacError("a frame is cut off")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        rest = self.value & ((1 << self.left) - 1)
        if not rest:
            raise FlacError("a frame is cut off")
        q = self.left - rest.bit_length()
        self.left -= q + 1
        return q


def decode_subframe(data: bytes, block: int, depth: int = 8) -> np.ndarray:
    """The samples of one subframe by the format's rules, one at a time; for what the lockstep decoder leaves over."""
    bits = _Bits(data)
    if bits.take(1):
        raise FlacError("a subframe header is invalid")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        return np.full(block, bits.signed(depth) << wasted, np.int32)
    if kind == 1:
        return np.array([bits.signed(depth) << wasted for _ in range(block)], np.int32)
    if 8 <= kind <= 12:
        coef, shift, order = FIXED[kind - 8], 0, kind - 8
        out = [bits.signed(depth) for _ in range(order)]
    elif kind >= 32:
        order = kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coef = [bits.signed(precision) for _ in range(order)]
        if shift < 0:
            raise FlacError("a predictor's shift is negative")
    else:
        raise FlacError(f"subframe type {kind} is reserved")
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or block % (1 << parts):
        raise FlacError("a residual's coding is invalid")
    for p in range(1 << parts):
        k = bits.take(4 + method)
        raw = bits.take(5) if k == (16 << method) - 1 else None
        for _ in range((block >> parts) - (order if p == 0 else 0)):
            if raw is None:
                u = bits.unary() << k | bits.take(k)
                e = (u >> 1) ^ -(u & 1)
            else:
                e = bits.signed(raw)
            out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    return np.array(out, np.int32) << wasted


def _read_head(data: bytes, at: int, number: int) -> int:
    """The offset behind a frame's header, which must be that of frame ``number``."""
    head = _head_small(number) if number < 4096 else _head(number)
    if data[at : at + len(head)] != head:
        raise FlacError(f"the header of frame {number} is wrong or of another kind")
    return at + len(head)


def parse(stream: bytes) -> tuple[int, bytes, list[int], int]:
    """(samples, MD5, offsets of all frames and of the end, offset of the first frame)."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info, seek = 4, False, None, None
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = body
        at += 4 + n
    if info is None or len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    total = packed & ((1 << 36) - 1)
    if info[:4] != BLOCK.to_bytes(2, "big") * 2 or (packed >> 36) & 0xFF != 7 or total % BLOCK or not total:
        raise FlacError("only 8-bit mono streams of whole blocks of 576 samples are read")
    count = total // BLOCK
    if seek is not None and len(seek) == 18 * count:
        points = np.frombuffer(seek, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        if (points["sample"] != np.arange(count) * BLOCK).any():
            raise FlacError("the seek table is wrong")
        offsets = [at + x for x in points["offset"].tolist()]
    else:  # walk over sync codes; a header has to carry the next number and a valid CRC-8
        offsets, spot = [], at
        for i in range(count):
            head = _head(i)
            spot = stream.find(head, spot)
            if spot < 0:
                raise FlacError(f"frame {i} is missing")
            offsets.append(spot)
            spot += len(head)
    return total, info[18:34], [*offsets, len(stream)], at


def _restore(res: np.ndarray, coef: np.ndarray, shift: np.ndarray, order: int) -> None:
    """Add a linear predictor's guesses to residuals, in place; the warm-up samples are there already."""
    x = np.ascontiguousarray(res.T)
    for i in range(order, BLOCK):
        guess = np.zeros(x.shape[1], np.int64)
        for j in range(order):
            guess += coef[:, j] * x[i - 1 - j]
        x[i] += guess >> shift
    res[:] = x.T


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (frames, 576) of subframes data[starts:ends], all 8-bit."""
    n = len(starts)
    out = np.zeros((n, BLOCK), np.int32)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))
    kind = data[starts].astype(np.int64)
    slow = np.zeros(n, bool)
    constant, raw = kind == 0, kind == 2
    out[constant] = data[starts[constant] + 1].view(np.int8)[:, None]
    if raw.any():
        out[raw] = data[(starts[raw] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    fixed, lpc = (kind & 1 == 0) & (kind >= 16) & (kind <= 24), (kind & 1 == 0) & (kind >= 64) & (kind < 128)
    slow |= ~(constant | raw | fixed | lpc)
    order = np.where(fixed, (kind >> 1) - 8, np.where(lpc, (kind >> 1) - 31, 0))
    pos = 8 * (starts + 1)
    rice = fixed | lpc
    for j in range(int(order[rice].max(initial=0))):
        warm = rice & (order > j)
        out[warm, j] = data[np.minimum(starts[warm] + 1 + j, len(data) - 1)].view(np.int8)
    pos = pos + 8 * order

    def peek(at: np.ndarray, width: int) -> np.ndarray:
        at = np.minimum(at, 8 * len(data))
        return ((words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    most = int(order[lpc].max(initial=0))
    coef, shift = np.zeros((n, most), np.int64), np.zeros(n, np.int64)
    if lpc.any():
        precision, shift[lpc] = peek(pos, 4) + 1, peek(pos[lpc] + 4, 5)
        slow |= lpc & (shift >= 16)
        for j in range(most):
            for width in np.unique(precision[lpc & (order > j)]):
                some = lpc & (order > j) & (precision == width)
                v = peek(pos[some] + 9 + width * j, int(width))
                coef[some, j] = v - ((v >> (width - 1)) << width)
        pos = pos + np.where(lpc, 9 + precision * order, 0)
    method, parts = peek(pos, 2), peek(pos + 2, 4)
    slow |= rice & ((method != 0) | (parts > 6))
    pos = pos + 6
    for p in np.unique(parts[rice & ~slow]):
        pick = np.nonzero(rice & ~slow & (parts == p))[0]
        at, own, odd = pos[pick], order[pick], np.zeros(len(pick), bool)
        res, k, length = np.zeros((BLOCK, len(pick)), np.int32), np.zeros(len(pick), np.int64), BLOCK >> int(p)
        limit, last = 8 * len(data), int(own.max(initial=0))
        for i in range(BLOCK):
            if i % length == 0:
                k = peek(at, 4)
                odd |= k == 15
                at = at + 4
                one, low, rest = np.uint64(1), (63 - k).astype(np.uint64), k + 1
            window = words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
            top = (window >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52
            q = 1075 - top  # zeros before the first 1; far too many if there is none in the window
            odd |= q + k > 56
            np.clip(q, 0, 56, out=q)
            u = (q << k) | (((window << (q.astype(np.uint64) + one)) >> one) >> low).astype(np.int64)
            step = q + rest
            e = (u >> 1) ^ -(u & 1)
            if i < last:
                idle = i < own
                step[idle] = 0
                e[idle] = 0
            res[i] = e
            at = np.minimum(at + step, limit)
        ended = ((at + 7) >> 3) == ends[pick]
        slow[pick] = odd | ~ended
        out[pick] += res.T
    for o in np.unique(order[fixed & ~slow]):
        some = fixed & ~slow & (order == o)
        out[some] = _sum_back(out[some], int(o))
    for o in np.unique(order[lpc & ~slow]):
        some = lpc & ~slow & (order == o)
        x = out[some]
        _restore(x, coef[some], shift[some], int(o))
        out[some] = x
    for i in np.nonzero(slow)[0]:
        out[i] = decode_subframe(data[starts[i] : ends[i]].tobytes(), BLOCK)
    return out


def _sum_back(x: np.ndarray, order: int) -> np.ndarray:
    """Undo a fixed predictor: the first ``order`` columns are samples, the others differences of that order."""
    heads = [x[:, :order].astype(np.int32)]
    for _ in range(order - 1):
        heads.append(np.diff(heads[-1], axis=1))
    e = x[:, order:]
    for level in range(order - 1, -1, -1):
        e = np.cumsum(np.concatenate([heads[level][:, -1:], e], axis=1), axis=1)[:, 1:]
    return np.concatenate([x[:, :order], e], axis=1)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of FLAC streams, every checksum verified."""
    parsed = [parse(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams), np.uint8)
    heads, starts, ends = [], [], []
    for s, b, (_, _, offsets, _) in zip(streams, base.tolist(), parsed, strict=False):
        for i in range(len(offsets) - 1):
            heads.append(b + _read_head(s, offsets[i], i))
        starts += [b + x for x in offsets[:-1]]
        ends += [b + x for x in offsets[1:]]
    heads, starts, ends = (np.array(v, np.int64) for v in (heads, starts, ends))
    out = np.zeros((len(starts), BLOCK), np.uint8)
    for i in range(0, len(starts), SLICE):
        h, s, e = heads[i : i + SLICE], starts[i : i + SLICE], ends[i : i + SLICE]
        low, high = int(s[0]), int(e[-1])
        part = data[low:high]
        if (crc16(part, s - low, e - low) != 0).any():  # a frame and its own CRC-16 give zero
            raise FlacError("a frame's CRC-16 is wrong")
        out[i : i + SLICE] = (_decode_frames(part, h - low, e - low - 2) & 255).astype(np.uint8)
    payloads, at = [], 0
    for total, md5, _, _ in parsed:
        samples = out[at : at + total // BLOCK]
        if hashlib.md5(samples.tobytes()).digest() != md5:
            raise FlacError("a stream's MD5 is wrong")
        payloads.append((samples ^ 128).tobytes())
        at += total // BLOCK
    return payloads


def seek(requests: list[tuple[bytes, int, int]]) -> list[bytes]:
    """The samples of each (stream, offset, count), as bytes of a payload: the seek table leads to the frames that hold them, and
    no others are looked at. Their headers' and their own checksums are verified, the stream's MD5 isn't."""
    parts, starts, ends, heads, at = [], [], [], [], 0
    for stream, offset, count in requests:
        total, _, offsets, _ = parse(stream)
        if offset < 0 or count < 1 or offset + count > total:
            raise FlacError(f"samples {offset} to {offset + count} of {total}")
        first, last = offset // BLOCK, (offset + count - 1) // BLOCK
        parts.append(stream[offsets[first] : offsets[last + 1]])
        for i in range(first, last + 1):
            shift = at - offsets[first]
            heads.append(_read_head(stream, offsets[i], i) + shift)
            starts.append(offsets[i] + shift)
            ends.append(offsets[i + 1] + shift)
        at += len(parts[-1])
    data = np.frombuffer(b"".join(parts), np.uint8)
    heads_, starts_, ends_ = (np.array(v, np.int64) for v in (heads, starts, ends))
    if not len(heads_):
        return []
    if (crc16(data, starts_, ends_) != 0).any():
        raise FlacError("a frame's CRC-16 is wrong")
    out = ((_decode_frames(data, heads_, ends_ - 2) & 255).astype(np.uint8) ^ 128).ravel()
    found, at = [], 0
    for _, offset, count in requests:
        frames = (offset + count - 1) // BLOCK - offset // BLOCK + 1
        found.append(out[at + offset % BLOCK : at + offset % BLOCK + count].tobytes())
        at += frames * BLOCK
    return found


# Spark ----------------------------------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    """A text's UTF-8, padded with bytes 255 to a positive multiple of 576."""
    data = (text or "").encode()
    return data + b"\xff" * (BLOCK - len(data) if not data else -len(data) % BLOCK)


def feature(data: bytes) -> str:
    """Integer features of the decoded samples: count, energy, zero crossings, smallest and largest sample."""
    x = (np.frombuffer(data, np.uint8) ^ 128).view(np.int8).astype(np.int64)
    return f"{len(x)}:{int((x * x).sum())}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}:{x.min()}:{x.max()}"


def _groups(column: pa.Array, most: int = 8 << 20) -> Iterator[list]:
    """The column's values in runs of about ``most`` bytes."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a FLAC stream) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                media = encode([payload(t) for t in texts])
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(texts)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def to_blocks(media: DataFrame, samples: int = 64 * BLOCK) -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (signed 8-bit) for every block of decoded samples; null streams give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for streams in _groups(batch.column(1)):
                ids = batch.column(0).slice(at, len(streams)).to_pylist()
                at += len(streams)
                pairs = [(i, s) for i, s in zip(ids, streams, strict=True) if s is not None]
                rows = []
                for (i, _), data in zip(pairs, decode([s for _, s in pairs]), strict=True):
                    pcm = (np.frombuffer(data, np.uint8) ^ 128).tobytes()
                    rows += [(i, o, len(pcm[o : o + samples]), pcm[o : o + samples]) for o in range(0, len(pcm), samples)]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["doc_id", "sample_offset", "n_samples", "pcm"])

    return bounded_batches(media.select("doc_id", "media")).mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, sample_offset long, n_samples int, pcm binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Decode every stream of ``to_media``'s table and digest both; the last samples are sought by their offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for streams in _groups(batch.column(2)):
                whole = decode(streams)
                tails = seek([(s, len(d) - TAIL, TAIL) for s, d in zip(streams, whole, strict=True)])
                sizes = batch.column(1).slice(at, len(streams)).to_pylist()
                rows = [(n, len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(t), len(s), hashlib.sha256(s).hexdigest(), feature(d)) for n, s, d, t in zip(sizes, streams, whole, tails, strict=True)]
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                yield pa.record_batch([batch.column(0).slice(at, len(streams)), *columns], names=["doc_id", *(x.split()[0] for x in DIGESTS.split(", "))])
                at += len(streams)

    return bounded_batches(media.select("doc_id", "n_bytes", "media")).mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    # A stream hardly compresses, but equal and similar texts have equal frames, which zstandard finds inside a page only.
    return digests(materialize(to_media(table(spark, sf_dir, "documents")), "media", "zstd", **STORED))
