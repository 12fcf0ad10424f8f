"""Slow searches for smaller deflate streams and GIF codes."""

from __future__ import annotations

import heapq
import zlib

from . import images
from .images import Unsupported

STRATEGIES = (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED)


def deflated(raw: bytes) -> bytes:
    """The smallest zlib stream over all strategies and table sizes at the highest level."""

    def one(strategy: int, memory: int) -> bytes:
        c = zlib.compressobj(9, zlib.DEFLATED, 15, memory, strategy)
        return c.compress(raw) + c.flush()

    return min((one(s, m) for s in STRATEGIES for m in (8, 9)), key=len)


def encode_png(data: bytes, keep_metadata: bool = True) -> bytes:
    """Like the plain encoder, then every filter and every way to deflate."""
    small = images.encode_png(data, keep_metadata)
    chunks = images.png_chunks(small)
    head = chunks[0][1]
    width, height, depth, kind = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    bpp, stride = max(1, samples * depth // 8), (width * samples * depth + 7) // 8
    rows = images._unfilter(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), height, stride, bpp)
    best = min((deflated(images._filtered(rows, bpp, f)) for f in (0, 1, 2, 3, 4, None)), key=len)
    out = [images.SIGNATURE]
    for k, body in chunks:
        out.append(images._chunk(k, best if k == b"IDAT" else body))
    done = b"".join(out)
    return min(done, small, key=len)


#: Places at which a GIF's code table may be cleared lie at least so many pixels apart, and are at most so many.
ALIGN, CLEARS = 10, 256


def _run(data: bytes, start: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy codes from a cleared table on: (end, code, its width) of each, until the table is full."""
    out, table = [], {}
    size, free, code = least + 1, (1 << least) + 2, data[start]
    for at in range(start + 1, len(data)):
        if (known := table.get((code, data[at]))) is not None:
            code = known
            continue
        out.append((at, code, size))
        if free == 4096:
            return out
        table[code, data[at]] = free
        if free == 1 << size and size < 12:
            size += 1
        free += 1
        code = data[at]
    out.append((len(data), code, size))
    return out


def lzw(data: bytes, least: int) -> bytes:
    """GIF codes with the clearing places that give the fewest bits: a shortest path over runs of greedy codes."""
    clear, end, n = 1 << least, (1 << least) + 1, len(data)
    step = max(ALIGN, -(-n // CLEARS))
    cost, before, waiting = {0: 0}, {}, [0]
    # a run's codes end where they end: the first end at or after each multiple of the step may begin a new run
    while waiting:
        start = heapq.heappop(waiting)
        if start == n:
            break
        bits, mark = cost[start], (start // step + 1) * step
        for i, (at, _, size) in enumerate(run := _run(data, start, least)):
            bits += size
            full = i == len(run) - 1 and at < n
            if at < n and at < mark and not full:
                continue
            mark = (at // step + 1) * step
            total = bits + (0 if at == n else min(12, size + 1))
            if at not in cost or total < cost[at]:
                if at not in cost:
                    heapq.heappush(waiting, at)
                cost[at], before[at] = total, start
    places = [n]
    while places[0]:
        places.insert(0, before[places[0]])
    out = _Codes()
    out.put(clear, least + 1)
    for start, stop in zip(places, places[1:], strict=False):
        for at, code, size in _run(data, start, least):
            out.put(code, size)
            if at >= stop:
                break
        out.put(end if stop == n else clear, _width_after(data, start, stop, least))
    return out.bytes()


def _width_after(data: bytes, start: int, stop: int, least: int) -> int:
    """The width of the code that follows the one that ends at ``stop``, as the reader knows it."""
    count = next(i for i, (at, _, _) in enumerate(_run(data, start, least), 1) if at >= stop)
    size, free = least + 1, (1 << least) + 2
    for _ in range(count):
        if free < 4096:
            if free == 1 << size and size < 12:
                size += 1
            free += 1
    return size


class _Codes:
    def __init__(self):
        self.out, self.held, self.bits = bytearray(), 0, 0

    def put(self, code: int, size: int) -> None:
        self.held |= code << self.bits
        self.bits += size
        while self.bits >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.bits -= 8

    def bytes(self) -> bytes:
        return bytes(self.out) + (bytes((self.held & 255,)) if self.bits else b"")


def encode_gif(data: bytes, keep_metadata: bool = True) -> bytes:
    """The same blocks, with each image's codes cleared where that pays, or as the plain encoder has them if those are fewer."""
    out = []
    for kind, head, body in images.gif_parts(data):
        if kind == "comment" and not keep_metadata:
            continue
        out.append(head)
        if kind == "image":
            codes = min(lzw(body, head[-1]), images._lzw_encode(body, head[-1]), key=len) if body else b""
            if body and images._lzw_decode(codes, head[-1], len(body)) != body:
                raise Unsupported("GIF codes")
            out += [bytes((len(p),)) + p for p in (codes[i : i + 255] for i in range(0, len(codes), 255))]
            out.append(b"\0")
    return b"".join(out)
