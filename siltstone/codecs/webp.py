"""WebP files (RFC 9649): lossless images are coded anew, lossy ones keep their bytes; metadata stays or goes.

The decoder reads every lossless stream: prefix codes of several groups, backward references, colour cache, all transforms. The encoder tries a
palette, or predictors chosen block by block after the green is taken off, and keeps the shorter one. Animations raise Unsupported.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from .images import Raster, Unsupported

Chunks = list[tuple[bytes, bytes]]
METADATA = frozenset((b"EXIF", b"XMP ", b"ICCP"))
#: Bits of the extended header that say which chunks there are. Fixed values.
ICC, ALPHA, EXIF, XMP, ANIMATION = 0x20, 0x10, 0x08, 0x04, 0x02
PREDICTOR, COLOR, SUBTRACT_GREEN, INDEXED = range(4)
#: The order in which lengths of code lengths are stored. Fixed values.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances mean pixels nearby: nearest first, then by columns away, the right one before the left one.
NEARBY = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: The longest match and the farthest place the prefixes can say, and the encoder's blocks of 16 by 16 pixels.
LENGTHS, LONGEST, FARTHEST, BLOCK_BITS = 24, 4096, (1 << 20) - 120, 4
#: Larger images raise Unsupported, which bounds a task's memory.
MAX_PIXELS = 1 << 24


def chunks(data: bytes) -> Chunks:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Unsupported("not a WebP file")
    out, at, end = [], 12, 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise Unsupported("truncated WebP file")
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise Unsupported("truncated WebP file")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    return out


def _file(parts: Chunks) -> bytes:
    body = b"WEBP" + b"".join(name + struct.pack("<I", len(part)) + part + b"\0" * (len(part) & 1) for name, part in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# Reading


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise Unsupported("truncated WebP stream")
            self.held |= self.data[self.at] << self.n
            self.at, self.n = self.at + 1, self.n + 8
        value = self.held & (1 << n) - 1
        self.held, self.n = self.held >> n, self.n - n
        return value

    def symbol(self, code: dict[tuple[int, int], int]) -> int:
        value, length = 0, 0
        while (found := code.get((length, value))) is None:
            value, length = value << 1 | self.take(1), length + 1
            if length > 15:
                raise Unsupported("bad prefix code")
        return found


def _canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) → symbol. One symbol alone has an empty code; any other code must be complete."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {(0, 0): used[0][1]}
    if sum(1 << 15 - n for n, _ in used) != 1 << 15:
        raise Unsupported("bad prefix code")
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[n, code] = s
        code, last = code + 1, n
    return out


def _prefix_code(bits: _Bits, size: int) -> dict[tuple[int, int], int]:
    if bits.take(1):
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        return {(1, 0): first, (1, 1): bits.take(8)} if two else {(0, 0): first}
    of_lengths = [0] * 19
    for place in LENGTH_ORDER[: 4 + bits.take(4)]:
        of_lengths[place] = bits.take(3)
    code = _canonical(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    lengths, before = [], 8
    while len(lengths) < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + bits.take(2))
        else:
            lengths += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    if len(lengths) > size:
        raise Unsupported("bad prefix code")
    return _canonical(lengths)


def _number(bits: _Bits, prefix: int) -> int:
    """A length or distance, by its prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> list[int]:
    """The ARGB values of an entropy-coded image; only the main one may have several groups of codes."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Unsupported("bad colour cache")
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    n, block, groups_of, across = width * height, 0, None, 0
    if main and bits.take(1):
        block = bits.take(3) + 2
        across = -(-width >> block)
        groups_of = [p >> 8 & 0xFFFF for p in _pixels(bits, across, -(-height >> block), False)]
    sizes = (256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_prefix_code(bits, s) for s in sizes] for _ in range(1 + max(groups_of, default=0) if groups_of else 1)]
    out: list[int] = []
    codes, symbol, seen = groups[0], bits.symbol, 0
    while len(out) < n:
        at = len(out)
        if groups_of:
            codes = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = symbol(codes[0])
        if s < 256:
            red = symbol(codes[1])
            blue = symbol(codes[2])
            out.append(symbol(codes[3]) << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTHS:
            length = _number(bits, s - 256)
            far = _number(bits, symbol(codes[4]))
            if far <= 120:
                x, y = NEARBY[far - 1]
                far = max(1, x + y * width)
            else:
                far -= 120
            if far > at or at + length > n:
                raise Unsupported("bad backward reference")
            for i in range(at - far, at - far + length):
                out.append(out[i])
        else:
            for p in out[seen:]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
            seen = len(out)
            out.append(cache[s - 256 - LENGTHS])
    return out


def _bytes(pixels: list[int], width: int) -> np.ndarray:
    """(height, width, 4) of blue, green, red, alpha."""
    return np.array(pixels, "<u4").view(np.uint8).reshape(-1, width, 4)


def _stream(bits: _Bits, width: int, height: int) -> np.ndarray:
    """The pixels of a whole lossless stream after its head, as _bytes gives them."""
    if width * height > MAX_PIXELS:
        raise Unsupported("too many pixels")
    transforms, wide = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (t[0] for t in transforms):
            raise Unsupported("repeated transform")
        if kind in (PREDICTOR, COLOR):
            block = bits.take(3) + 2
            across = -(-wide >> block)
            transforms.append((kind, wide, block, _bytes(_pixels(bits, across, -(-height >> block), False), across)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, wide, 0, None))
        else:
            size = bits.take(8) + 1
            table = np.cumsum(_bytes(_pixels(bits, size, 1, False), size), axis=1, dtype=np.uint8)[0]
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, wide, packed, table))
            wide = -(-wide >> packed)
    image = _bytes(_pixels(bits, wide, height, True), wide)
    for kind, wide, size, values in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., [0, 2]] += image[..., 1:2]
        elif kind == INDEXED:
            image = _unindexed(image, wide, size, values)
        elif kind == COLOR:
            image = _recolored(image, size, values)
        else:
            image = _unpredicted(image, size, values)
    return image


def _unindexed(image: np.ndarray, width: int, packed: int, table: np.ndarray) -> np.ndarray:
    """Places in the table, several to a pixel, as colours; places beyond it are transparent black."""
    per, depth = 1 << packed, 8 >> packed
    places = (image[..., 1][..., None] >> (depth * np.arange(per)) & (1 << depth) - 1).reshape(len(image), -1)[:, :width]
    return np.vstack([table, np.zeros((256 - len(table), 4), np.uint8)])[places]


def _spread(values: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """Each block's values for each of its pixels."""
    return values.repeat(1 << block, axis=0)[:height].repeat(1 << block, axis=1)[:, :width]


def _recolored(image: np.ndarray, block: int, values: np.ndarray) -> np.ndarray:
    how = _spread(values, block, *image.shape[:2]).view(np.int8).astype(np.int32)
    green = image[..., 1].view(np.int8).astype(np.int32)
    out = image.copy()
    out[..., 2] = image[..., 2] + (how[..., 0] * green >> 5)
    red = out[..., 2].view(np.int8).astype(np.int32)
    out[..., 0] = image[..., 0] + (how[..., 1] * green >> 5) + (how[..., 2] * red >> 5)
    return out


def _guess(mode: int, left, top, right, corner):
    """A predictor's value for one pixel, or for arrays of them whose last axis holds the components. Inputs are signed."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:  # whichever of both is nearer to left + top - corner
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)  # modes 0, 14 and 15


def _unpredicted(image: np.ndarray, block: int, values: np.ndarray) -> np.ndarray:
    """Rows from the top. Modes that look at the row above only take a whole run of pixels at once."""
    height, width, _ = image.shape
    out = image.astype(np.int32)
    out[0, 0] = (out[0, 0] + (0, 0, 0, 255)) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    modes = values[..., 1] & 15
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for first in range(0, width, 1 << block):
            start, stop = max(1, first), min(width, first + (1 << block))
            mode = int(modes[y >> block, first >> block])
            if start >= stop:
                continue
            # right of the last column follows the first pixel of the row itself
            right = np.vstack([above[start + 1 : stop + 1], row[:1]]) if stop == width else above[start + 1 : stop + 1]
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                row[start:stop] = (row[start:stop] + _guess(mode, above[start:stop], above[start:stop], right, above[start - 1 : stop - 1])) & 255
            elif mode == 1:
                row[start:stop] = (row[start - 1] + np.cumsum(row[start:stop], axis=0)) & 255
            else:
                for x in range(start, stop):
                    row[x] = (row[x] + _guess(mode, row[x - 1], above[x], right[x - start], above[x - 1])) & 255
    return out.astype(np.uint8)


def _lossless(body: bytes) -> np.ndarray:
    if body[:1] != b"\x2f":
        raise Unsupported("not a lossless stream")
    bits = _Bits(body[1:])
    width, height, _, version = bits.take(14) + 1, bits.take(14) + 1, bits.take(1), bits.take(3)
    if version:
        raise Unsupported("unknown version")
    return _stream(bits, width, height)


def decode(data: bytes) -> Raster:
    """(width, height, RGBA pixels) of a lossless file."""
    parts = dict(reversed(chunks(data)))
    if b"VP8L" not in parts or b"ANIM" in parts:
        raise Unsupported("not one lossless image")
    image = _lossless(parts[b"VP8L"])
    return image.shape[1], image.shape[0], np.ascontiguousarray(image[..., [2, 1, 0, 3]])


def alpha(data: bytes) -> np.ndarray:
    """The alpha of a lossy file whose alpha is a lossless stream without a filter."""
    parts = dict(reversed(chunks(data)))
    head, body = parts[b"VP8X"], parts[b"ALPH"]
    if body[0] & 0xF != 1:
        raise Unsupported("alpha variant")
    return _stream(_Bits(body[1:]), int.from_bytes(head[4:7], "little") + 1, int.from_bytes(head[7:10], "little") + 1)[..., 1]


# Writing


class _Out:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            whole = self.n >> 3
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value, self.n = self.value >> 8 * whole, self.n & 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def _lengths(count: Counter, size: int, most: int) -> list[int]:
    """Code lengths by symbol, at most ``most``: Huffman's, over counts that are halved until it fits."""
    out = [0] * size
    weight = {s: n for s, n in count.items() if n}
    if len(weight) < 2:
        for s in weight:
            out[s] = 1
        return out
    while True:
        heap = [(n, s, (s,)) for s, n in weight.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(weight, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(depth.values()) <= most:
            break
        weight = {s: (n + 1) >> 1 for s, n in weight.items()}
    for s, n in depth.items():
        out[s] = n
    return out


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol → (its code as bits go out, length); one symbol alone needs no bit."""
    return {s: (int(f"{code:0{n}b}"[::-1], 2), n) if n else (0, 0) for (n, code), s in _canonical(lengths).items()} if any(lengths) else {}


def _put_code(out: _Out, count: Counter, size: int) -> dict[int, tuple[int, int]]:
    used = sorted(s for s, n in count.items() if n) or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 1:
            return {used[0]: (0, 0)}
        out.put(used[1], 8)
        return {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = _lengths(count, size, 15)
    runs, at, before = [], 0, 8
    while at < size:
        n, stop = lengths[at], at + 1
        while stop < size and lengths[stop] == n:
            stop += 1
        left = stop - at
        if n and n != before:
            runs.append((n, 0, 0))
            left, before = left - 1, n
        while left:
            if n == 0 and left >= 3:
                step = min(left, 138)
                runs.append((18, step - 11, 7) if step >= 11 else (17, step - 3, 3))
            elif n and left >= 3:
                step = min(left, 6)
                runs.append((16, step - 3, 2))
            else:
                step = 1
                runs.append((n, 0, 0))
            left -= step
        at = stop
    of_lengths = _lengths(Counter(s for s, _, _ in runs), 19, 7)
    stored = [of_lengths[p] for p in LENGTH_ORDER]
    n = max(4, max(i + 1 for i, v in enumerate(stored) if v))
    out.put(0, 1)
    out.put(n - 4, 4)
    for v in stored[:n]:
        out.put(v, 3)
    out.put(0, 1)
    codes = _codes(of_lengths)
    for s, extra, width in runs:
        out.put(*codes[s])
        out.put(extra, width)
    return _codes(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    rest = value - 1 - (2 << extra)
    return 2 * extra + 2 + (rest >> extra), rest & (1 << extra) - 1, extra


def _references(pixels: list[int], width: int) -> list[tuple[int, int]]:
    """Greedy parse: (pixel, 0), or (length, distance) of a match with the pixel before, the row above, or the last place with the same three pixels."""
    out, at, n, last = [], 0, len(pixels), {}
    while at < n:
        best, far = 0, 0
        key = tuple(pixels[at : at + 3])
        for d in {1, width, at - last.get(key, at)}:
            if 0 < d <= min(at, FARTHEST):
                k, most = 0, min(n - at, LONGEST)
                while k < most and pixels[at + k] == pixels[at + k - d]:
                    k += 1
                if k > best:
                    best, far = k, d
        step = best if best >= 3 else 1
        out.append((best, far) if best >= 3 else (pixels[at], 0))
        for i in range(at, min(at + step, at + 64)):
            last[tuple(pixels[i : i + 3])] = i
        at += step
    return out


def _put_pixels(out: _Out, image: np.ndarray, main: bool) -> None:
    height, width, _ = image.shape
    near = {}
    for i, (x, y) in reversed(list(enumerate(NEARBY))):
        near[max(1, x + y * width)] = i + 1
    steps, counts = [], [Counter() for _ in range(5)]
    for a, d in _references(np.ascontiguousarray(image).view("<u4").ravel().tolist(), width):
        if d:
            length, far = _prefix(a), _prefix(near.get(d, d + 120))
            symbols = [(0, 256 + length[0], *length[1:]), (4, *far)]
        else:
            symbols = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        for which, s, _, _ in symbols:
            counts[which][s] += 1
        steps += symbols
    out.put(0, 1)
    if main:
        out.put(0, 1)
    codes = [_put_code(out, c, s) for c, s in zip(counts, (256 + LENGTHS, 256, 256, 256, 40), strict=True)]
    for which, s, extra, n in steps:
        out.put(*codes[which][s])
        out.put(extra, n)


def _predicted(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the predictors leave, modes of blocks); each block takes the mode that leaves least."""
    height, width, _ = image.shape
    x = image.astype(np.int32)
    left, top, corner, right = (np.zeros_like(x) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:], right[1:, :-1], right[1:, -1] = x[:, :-1], x[:-1], x[:-1, :-1], x[:-1, 1:], x[1:, 0]
    down, across = -(-height >> BLOCK_BITS), -(-width >> BLOCK_BITS)
    best = np.full((down, across), 1 << 60)
    modes, rest = np.zeros((down, across), np.uint8), np.zeros_like(image)
    for mode in range(14):
        off = (x - _guess(mode, left, top, right, corner)).astype(np.uint8)
        cost = np.pad(np.abs(off.view(np.int8).astype(np.int64)).sum(-1), ((0, (-height) % (1 << BLOCK_BITS)), (0, (-width) % (1 << BLOCK_BITS))))
        cost = cost.reshape(down, 1 << BLOCK_BITS, across, -1).sum((1, 3))
        take = cost < best
        best[take], modes[take] = cost[take], mode
        here = _spread(take, BLOCK_BITS, height, width)
        rest[here] = off[here]
    rest[0, 1:] = (x - left)[0, 1:].astype(np.uint8)
    rest[1:, 0] = (x - top)[1:, 0].astype(np.uint8)
    rest[0, 0] = (x[0, 0] - (0, 0, 0, 255)).astype(np.uint8)
    return rest, modes


def _head(image: np.ndarray) -> _Out:
    out = _Out()
    out.put(0x2F, 8)
    out.put(image.shape[1] - 1, 14)
    out.put(image.shape[0] - 1, 14)
    out.put(int((image[..., 3] != 255).any()), 1)
    out.put(0, 3)
    return out


def _with_predictors(image: np.ndarray) -> bytes:
    out = _head(image)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    less = image.copy()
    less[..., [0, 2]] -= image[..., 1:2]
    rest, modes = _predicted(less)
    out.put(1 | PREDICTOR << 1, 3)
    out.put(BLOCK_BITS - 2, 3)
    how = np.zeros((*modes.shape, 4), np.uint8)
    how[..., 1], how[..., 3] = modes, 255
    _put_pixels(out, how, False)
    out.put(0, 1)
    _put_pixels(out, rest, True)
    return out.bytes()


def _with_palette(image: np.ndarray, table: np.ndarray, places: np.ndarray) -> bytes:
    out = _head(image)
    size, (height, width) = len(table), places.shape
    packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    out.put(1 | INDEXED << 1, 3)
    out.put(size - 1, 8)
    _put_pixels(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
    out.put(0, 1)
    per = 1 << packed
    wide = np.pad(places, ((0, 0), (0, -width % per))).reshape(height, -1, per)
    green = (wide << (8 >> packed) * np.arange(per)).sum(-1)
    _put_pixels(out, np.dstack([np.zeros_like(green), green, np.zeros_like(green), np.full_like(green, 255)]).astype(np.uint8), True)
    return out.bytes()


def stream(pixels: np.ndarray) -> bytes:
    """The shorter lossless stream of RGBA pixels."""
    image = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    ways = [_with_predictors(image)]
    table, places = np.unique(image.view("<u4").ravel(), return_inverse=True)
    if len(table) <= 256:
        ways.append(_with_palette(image, table.view(np.uint8).reshape(-1, 4), places.reshape(image.shape[:2])))
    return min(ways, key=len)


def plain(pixels: np.ndarray) -> bytes:
    """A file without transforms: what a hasty encoder writes."""
    image = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    out = _head(image)
    out.put(0, 1)
    _put_pixels(out, image, True)
    return _file([(b"VP8L", out.bytes())])


def encode(data: bytes, keep_metadata: bool = True) -> bytes:
    """A lossless image coded anew where that is shorter, a lossy one as it is; without metadata its chunks go, and their marks in the head."""
    parts = chunks(data)
    if any(name in (b"ANIM", b"ANMF") for name, _ in parts):
        raise Unsupported("animation")
    out = []
    for name, body in parts:
        if name in METADATA and not keep_metadata:
            continue
        if name == b"VP8X" and not keep_metadata:
            body = bytes((body[0] & ~(ICC | EXIF | XMP),)) + body[1:]
        if name == b"VP8L":
            body = min(stream(decode(data)[2]), body, key=len)
        out.append((name, body))
    return _file(out)


def canonical(data: bytes) -> bytes:
    """Size and RGBA pixels of a lossless file; the coded image and its alpha of a lossy one."""
    parts = chunks(data)
    names = [name for name, _ in parts]
    if b"ANIM" in names or names.count(b"VP8 ") + names.count(b"VP8L") != 1:
        raise Unsupported("not one image")
    if b"VP8L" in names:
        width, height, pixels = decode(data)
        return b"%d %d " % (width, height) + pixels.tobytes()
    return b"".join(name + b"%d:" % len(body) + body for name, body in parts if name in (b"VP8 ", b"ALPH"))
