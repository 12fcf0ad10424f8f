"""FLAC: decoding of every subframe kind, and encoding with fixed predictors, stereo decorrelation and partitioned Rice codes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .images import Unsupported

BLOCK = 4096
STREAMINFO, PADDING, PICTURE = 0, 1, 6


@dataclass
class Sound:
    rate: int
    bits: int
    samples: np.ndarray  # (n, channels) of int64
    blocks: list[tuple[int, bytes]]  # metadata other than stream information
    digest: bytes = b""


def _crc(bits: int, poly: int) -> list[int]:
    table, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        table.append(c)
    return table


_CRC8, _CRC16 = _crc(8, 0x07), _crc(16, 0x8005)


def _check(data: bytes, table: list[int], bits: int) -> int:
    c, shift, mask = 0, bits - 8, (1 << bits) - 1
    for b in data:
        c = (c << 8 ^ table[c >> shift ^ b]) & mask
    return c


def digest(samples: np.ndarray, bits: int) -> bytes:
    """MD5 of the interleaved samples in whole bytes, lowest first."""
    size = (bits + 7) // 8
    raw = np.ascontiguousarray(samples, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :size]
    return hashlib.md5(raw.tobytes()).digest()


def metadata(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """The metadata blocks with the stream information first, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise Unsupported("not a FLAC file")
    out, at, last = [], 4, False
    while not last:
        if at + 4 > len(data):
            raise Unsupported("truncated FLAC")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        out.append((kind & 127, data[at + 4 : at + 4 + size]))
        last, at = bool(kind & 128), at + 4 + size
    if not out or out[0][0] != STREAMINFO or len(out[0][1]) < 34:
        raise Unsupported("no stream information")
    return out, at


class _Reader:
    """Bits of a frame. ``ahead[p]`` is the place of the next one bit from p on."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        places = np.where(self.bits, np.arange(n), n)
        self.ahead = np.minimum.accumulate(places[::-1])[::-1]
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at, self.at + n
        if b > len(self.bits):
            raise Unsupported("truncated FLAC frame")
        self.at = b
        last = (b + 7) // 8
        return int.from_bytes(self.data[a // 8 : last], "big") >> 8 * last - b & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def rice(self, count: int, k: int) -> np.ndarray:
        ahead, at, step = self.ahead, self.at, k + 1
        ends = []
        try:
            for _ in range(count):
                one = int(ahead[at])
                ends.append(one)
                at = one + step
        except IndexError:
            raise Unsupported("truncated FLAC frame") from None
        if at > len(self.bits):
            raise Unsupported("truncated FLAC frame")
        ones = np.array(ends, np.int64)
        u = ones - np.r_[self.at, ones[:-1] + step] if count else ones
        for i in range(k):
            u = u << 1 | self.bits[ones + 1 + i]
        self.at = at
        return (u >> 1) ^ -(u & 1)


def _residual(r: _Reader, block: int, order: int) -> np.ndarray:
    method, parts = r.take(2), r.take(4)
    if method > 1:
        raise Unsupported("reserved residual coding")
    width, out = 4 + method, []
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        k = r.take(width)
        if k == (1 << width) - 1:
            raw = r.take(5)
            out.append(np.array([r.signed(raw) for _ in range(n)], np.int64))
        else:
            out.append(r.rice(n, k))
    return np.concatenate(out)


def _subframe(r: _Reader, block: int, bits: int) -> np.ndarray:
    if r.take(1):
        raise Unsupported("bad subframe")
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = 1
        while not r.take(1):
            wasted += 1
        bits -= wasted
    if kind == 0:
        x = np.full(block, r.signed(bits), np.int64)
    elif kind == 1:
        x = np.array([r.signed(bits) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12:
        warm = np.array([r.signed(bits) for _ in range(kind - 8)], np.int64)
        x = _integrated(warm, _residual(r, block, kind - 8))
    elif kind >= 32:
        order = kind - 31
        x = [r.signed(bits) for _ in range(order)]
        precision = r.take(4) + 1
        shift = r.signed(5)
        if precision == 16 or shift < 0:
            raise Unsupported("bad predictor")
        weights = [r.signed(precision) for _ in range(order)]
        for e in _residual(r, block, order).tolist():
            x.append(e + (sum(w * v for w, v in zip(weights, reversed(x[-order:]), strict=True)) >> shift))
        x = np.array(x, np.int64)
    else:
        raise Unsupported("reserved subframe")
    return x << wasted


def _integrated(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undoes as many differences as there are warm-up samples."""
    order = len(warm)
    x = residual
    for j in range(order - 1, -1, -1):  # x holds the differences of order j + 1 from place order on
        start = np.diff(warm, n=j)[-1]
        x = start + np.cumsum(x)
    return np.r_[warm, x]


def _header(data: bytes, at: int) -> tuple[int, int, int]:
    """Samples in the block, channel code, and the header's length."""
    if int.from_bytes(data[at : at + 2], "big") >> 2 != 0x3FFE:
        raise Unsupported("no frame")
    size, rate, channels = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4
    lead = data[at + 4]
    n = at + 5 + (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
    if size in (6, 7):
        block = int.from_bytes(data[n : n + size - 5], "big") + 1
        n += size - 5
    elif size:
        block = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    else:
        raise Unsupported("reserved block size")
    n += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _check(data[at:n], _CRC8, 8) != data[n]:
        raise Unsupported("bad frame header")
    return block, channels, n + 1 - at


def decode(data: bytes) -> Sound:
    blocks, at = metadata(data)
    info = blocks[0][1]
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    parts, done = [], 0
    while at + 6 < len(data) and (not total or done < total):
        block, code, head = _header(data, at)
        room = head + 16 + channels * (block * (bits + 2) // 8 + 64) * 2
        r = _Reader(data[at + head : at + room])
        wide = [bits + (code in (8, 10) and i == 1 or code == 9 and i == 0) for i in range(channels)]
        x = [_subframe(r, block, int(w)) for w in wide]
        if code == 8:
            x[1] = x[0] - x[1]
        elif code == 9:
            x[0] = x[0] + x[1]
        elif code == 10:
            both = x[0] << 1 | x[1] & 1
            x = [both + x[1] >> 1, both - x[1] >> 1]
        size = head + (r.at + 7) // 8
        if _check(data[at : at + size], _CRC16, 16) != int.from_bytes(data[at + size : at + size + 2], "big"):
            raise Unsupported("bad frame")
        parts.append(np.stack(x, axis=1))
        at, done = at + size + 2, done + block
    samples = np.concatenate(parts) if parts else np.zeros((0, channels), np.int64)
    if any(info[18:34]) and digest(samples, bits) != info[18:34]:
        raise Unsupported("samples don't have their digest")
    return Sound(rate, bits, samples, blocks[1:], info[18:34])


def _fixed(values: list[int], widths: list[int]) -> np.ndarray:
    return np.array([v >> i & 1 for v, w in zip(values, widths, strict=True) for i in range(w - 1, -1, -1)], np.uint8)


def _rice_bits(u: np.ndarray, k: int) -> np.ndarray:
    high = u >> k
    ends = np.cumsum(high + 1 + k)
    out = np.zeros(int(ends[-1]) if len(u) else 0, np.uint8)
    one = ends - k - 1
    out[one] = 1
    for i in range(k):
        out[one + 1 + i] = u >> k - 1 - i & 1
    return out


def _coded(residual: np.ndarray, block: int, order: int) -> tuple[int, list]:
    """Bits and plan (partition order, [(k, values)]) of the cheapest partitioned Rice code."""
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    finest = 0
    while finest < 6 and block % (2 << finest) == 0 and block >> finest + 1 > order:
        finest += 1
    # sums of shifted values in the finest parts, from which those of wider parts are added up; zeros stand for the warm-up samples
    ks = np.arange(int(u.max()).bit_length() + 3)
    sums = (np.r_[np.zeros(order, np.int64), u] >> ks[:, None]).reshape(len(ks), 1 << finest, -1).sum(axis=2)
    best = None
    for parts in range(finest + 1):
        high = sums.reshape(len(ks), 1 << parts, -1).sum(axis=2)
        n = np.full(1 << parts, block >> parts)
        n[0] -= order
        guess = np.maximum(0, np.frexp((high[0] // n).astype(float))[1] - 1)
        costs = np.where((ks[:, None] >= guess - 1) & (ks[:, None] < guess + 3), high + n * (1 + ks[:, None]), np.iinfo(np.int64).max)
        size = int(costs.min(axis=0).sum()) + (5 << parts)
        if best is None or size < best[0]:
            best = size, parts, n, costs.argmin(axis=0)
    size, parts, n, k = best
    return size, (parts, list(zip(k.tolist(), np.split(u, np.cumsum(n)[:-1]), strict=True)))


def _encoded(x: np.ndarray, bits: int) -> tuple[int, list[np.ndarray]]:
    """The cheapest subframe of one channel: its bits, in pieces."""
    if (x == x[0]).all():
        return 8 + bits, [_fixed([0, int(x[0])], [8, bits])]
    options = []
    for order in range(min(5, len(x))):
        size, plan = _coded(np.diff(x, n=order), len(x), order)
        options.append((size + order * bits + 14, order, plan))
    size, order, (parts, plan) = min(options, key=lambda o: o[0])
    if size >= 8 + bits * len(x):
        return 8 + bits * len(x), [_fixed([2, *x.tolist()], [8, *[bits] * len(x)])]
    wide = any(k > 14 for k, _ in plan)
    pieces = [_fixed([8 + order << 1, *x[:order].tolist(), int(wide), parts], [8, *[bits] * order, 2, 4])]
    for k, v in plan:
        pieces += [_fixed([k], [5 if wide else 4]), _rice_bits(v, k)]
    return size, pieces


def _number(n: int) -> bytes:
    if n < 0x80:
        return bytes((n,))
    size = next(i for i in range(2, 8) if n < 1 << 5 * i + 1)
    tail = bytes(0x80 | n >> 6 * i & 63 for i in range(size - 2, -1, -1))
    return bytes((0xFF00 >> size & 0xFF | n >> 6 * (size - 1),)) + tail


def write(sound: Sound) -> bytes:
    n, channels = sound.samples.shape
    if not 1 <= channels <= 8 or not 4 <= sound.bits <= 32:
        raise Unsupported("FLAC variant")
    frames = []
    for i in range(0, n, BLOCK):
        part = sound.samples[i : i + BLOCK]
        code, made = channels - 1, [_encoded(part[:, c], sound.bits) for c in range(channels)]
        if channels == 2:
            left, right = part[:, 0], part[:, 1]
            side, middle = _encoded(left - right, sound.bits + 1), _encoded(left + right >> 1, sound.bits)
            code, made = min(((1, made), (8, [made[0], side]), (9, [side, made[1]]), (10, [middle, side])), key=lambda o: sum(s for s, _ in o[1]))
        head = b"\xff\xf8\x70" + bytes((code << 4,)) + _number(i // BLOCK) + (len(part) - 1).to_bytes(2, "big")
        head += bytes((_check(head, _CRC8, 8),))
        body = head + np.packbits(np.concatenate([b for _, pieces in made for b in pieces])).tobytes()
        frames.append(body + _check(body, _CRC16, 16).to_bytes(2, "big"))
    packed = sound.rate << 44 | channels - 1 << 41 | sound.bits - 1 << 36 | n
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + digest(sound.samples, sound.bits)
    blocks = [(STREAMINFO, info), *sound.blocks]
    out = b"".join(bytes((kind | (128 if i == len(blocks) - 1 else 0),)) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))
    return b"fLaC" + out + b"".join(frames)


def encode(data: bytes, keep_metadata: bool = True) -> bytes:
    """The same samples; metadata blocks other than padding stay, or go without metadata (seek tables point into the old frames, so they go)."""
    sound = decode(data)
    sound.blocks = [(k, b) for k, b in sound.blocks if keep_metadata and k not in (PADDING, 3)]
    return write(sound)


def canonical(data: bytes) -> bytes:
    s = decode(data)
    return b"%d %d %d " % (s.rate, s.bits, s.samples.shape[1]) + s.samples.astype("<i8").tobytes()
