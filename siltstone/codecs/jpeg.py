"""JPEG files: repeated metadata goes, or all of it, and sequential Huffman scans get tables of their own, as short as can be.

The coded coefficients are read as symbols and their extra bits and written again with the new tables, so every coefficient stays. Files of other
kinds (progressive, arithmetic, 12-bit, several scans) keep their scans byte for byte.
"""

from __future__ import annotations

from collections import Counter

from .images import Unsupported


def segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, bytes with their head) from the start to the first scan; the rest is one piece with marker 0."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("not a JPEG")
    out, at = [(0xD8, data[:2])], 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unsupported("bad marker")
        marker = data[at + 1]
        if marker == 0xDA:
            return [*out, (0, data[at:])]
        if marker == 0xFF:
            at += 1
            continue
        size = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out.append((marker, data[at : at + size]))
        at += size
    raise Unsupported("no scan")


def is_metadata(marker: int) -> bool:
    """Application segments and comments; the colour transform of APP14 and the density of APP0 belong to the picture."""
    return 0xE1 <= marker <= 0xEF and marker != 0xEE or marker == 0xFE


def without_repeats(data: bytes, keep_metadata: bool = True) -> bytes:
    """Each metadata segment once, in the order of first appearance; none without metadata."""
    seen: set[bytes] = set()
    out = []
    for marker, body in segments(data):
        if is_metadata(marker):
            if not keep_metadata or body in seen:
                continue
            seen.add(body)
        out.append(body)
    return b"".join(out)


Tables = dict[int, tuple[tuple[int, ...], bytes]]  # class and number → codes of each length, symbols


def _tables(parts: list[tuple[int, bytes]]) -> Tables:
    out: Tables = {}
    for marker, body in parts:
        at = 4
        while marker == 0xC4 and at + 17 <= len(body):
            counts = tuple(body[at + 1 : at + 17])
            out[body[at]] = counts, body[at + 17 : at + 17 + sum(counts)]
            at += 17 + sum(counts)
    return out


def _codes(counts: tuple[int, ...], symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of each symbol."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _shortest(count: Counter) -> tuple[tuple[int, ...], bytes]:
    """The code lengths of least total, at most 16 and without the code of all ones, by the standard's procedure."""
    freq = {**count, 256: 1}
    size, chains = Counter(), {s: [s] for s in freq}
    while len(freq) > 1:
        a = min(freq, key=lambda s: (freq[s], -s))
        fa = freq.pop(a)
        b = min(freq, key=lambda s: (freq[s], -s))
        freq[b] += fa
        chains[b] += chains.pop(a)
        for s in chains[b]:
            size[s] += 1
    bits = Counter(size.values())
    for i in range(max(bits, default=0), 16, -1):
        while bits[i]:
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(i for i, n in bits.items() if n)
    bits[last] -= 1
    order = sorted((s for s in size if s != 256), key=lambda s: (size[s], s))
    return tuple(bits[i] for i in range(1, 17)), bytes(order)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= len(self.data):
                self.held, self.n = self.held << 8 | 0xFF, self.n + 8
            else:
                self.held, self.n = self.held << 8 | self.data[self.at], self.n + 8
            self.at += 1
            if self.at > len(self.data) + 8:
                raise Unsupported("truncated scan")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.get((length, code))) is not None:
                return s
        raise Unsupported("bad code")


def scan(data: bytes) -> tuple[list[tuple[int, bytes]], bytes, list[list[tuple[int, int, int]]], bytes]:
    """Segments before the scan, the scan's header, for each restart interval its (table, symbol, extra bits), and what follows.

    Only a single sequential Huffman scan of 8-bit samples is read; others raise Unsupported."""
    *parts, (_, rest) = segments(data)
    frame = next((b for m, b in parts if m in (0xC0, 0xC1)), None)
    if frame is None or frame[4] != 8:
        raise Unsupported("not sequential")
    height, width = int.from_bytes(frame[5:7], "big"), int.from_bytes(frame[7:9], "big")
    shape = {frame[10 + 3 * i]: (frame[11 + 3 * i] >> 4, frame[11 + 3 * i] & 15) for i in range(frame[9])}
    size = 2 + int.from_bytes(rest[2:4], "big")
    head, coded = rest[:size], rest[size:]
    if head[4] != len(shape) or not width or not height:
        raise Unsupported("several scans")
    uses = [(head[5 + 2 * i], head[6 + 2 * i] >> 4, head[6 + 2 * i] & 15) for i in range(head[4])]
    interval = next((int.from_bytes(b[4:6], "big") for m, b in parts if m == 0xDD), 0)
    tables = {k: {(n, c): s for n, c, s in _codes(*v)} for k, v in _tables(parts).items()}
    across, down = max(h for h, _ in shape.values()), max(v for _, v in shape.values())
    if len(uses) == 1:
        blocks, units = [(uses[0], 1)], -(-width // 8) * -(-height // 8)
    else:
        blocks, units = [(u, shape[u[0]][0] * shape[u[0]][1]) for u in uses], -(-width // (8 * across)) * -(-height // (8 * down))
    # the coded bytes, cut at restart marks, without stuffed zeros
    stop, pieces, begin = 0, [], 0
    while True:
        stop = coded.find(b"\xff", stop)
        if stop < 0 or stop + 1 >= len(coded):
            raise Unsupported("scan without end")
        if coded[stop + 1] == 0:
            stop += 2
        elif 0xD0 <= coded[stop + 1] <= 0xD7:
            pieces.append(coded[begin:stop])
            begin = stop = stop + 2
        else:
            pieces.append(coded[begin:stop])
            break
    out, left = [], units
    for piece in pieces:
        bits, mine = _Bits(piece.replace(b"\xff\0", b"\xff")), []
        for _ in range(min(left, interval or left)):
            left -= 1
            for (_, dc, ac), n in blocks:
                for _ in range(n):
                    s = bits.symbol(tables[dc])
                    mine.append((dc, s, bits.take(s & 15)))
                    k = 1
                    while k < 64:
                        s = bits.symbol(tables[16 | ac])
                        mine.append((16 | ac, s, bits.take(s & 15)))
                        if s == 0:
                            break
                        k += (s >> 4) + 1
        out.append(mine)
    tail = coded[stop:]
    if left or tail[:2] != b"\xff\xd9":
        raise Unsupported("several scans")
    return parts, head, out, tail


def write(parts: list[tuple[int, bytes]], head: bytes, intervals: list[list[tuple[int, int, int]]], tail: bytes, tables: Tables) -> bytes:
    """The file with these tables, in one segment before the scan."""
    codes = {k: {s: (n, c) for n, c, s in _codes(*v)} for k, v in tables.items()}
    body = b"".join(bytes((k, *counts)) + symbols for k, (counts, symbols) in sorted(tables.items()))
    out = [b for m, b in parts if m != 0xC4]
    out += [b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body, head]
    for i, mine in enumerate(intervals):
        held, n, raw = 0, 0, bytearray()
        for table, symbol, extra in mine:
            length, code = codes[table][symbol]
            size = symbol & 15
            held, n = (held << length | code) << size | extra, n + length + size
            while n >= 8:
                raw.append(held >> n - 8)
                n -= 8
                held &= (1 << n) - 1
        if n:
            raw.append((held << 8 - n | (1 << 8 - n) - 1) & 255)
        out.append(bytes(raw).replace(b"\xff", b"\xff\0"))
        if i + 1 < len(intervals):
            out.append(bytes((0xFF, 0xD0 + i % 8)))
    return b"".join(out) + tail


def encode(data: bytes, keep_metadata: bool = True) -> bytes:
    """Without repeated metadata, and with the shortest tables where the scan can be read."""
    small = without_repeats(data, keep_metadata)
    try:
        parts, head, intervals, tail = scan(small)
    except (Unsupported, KeyError, IndexError, StopIteration):
        return small
    counts: dict[int, Counter] = {}
    for mine in intervals:
        for table, symbol, _ in mine:
            counts.setdefault(table, Counter())[symbol] += 1
    return min(small, write(parts, head, intervals, tail, {k: _shortest(c) for k, c in counts.items()}), key=len)


def canonical(data: bytes) -> bytes:
    """What must be equal for two files to show the same: all segments but metadata and tables of codes, and the coefficients; where the scan can't be
    read, the tables and the coded bytes."""
    try:
        parts, head, intervals, tail = scan(data)
    except (Unsupported, KeyError, IndexError, StopIteration):
        return b"".join(body for marker, body in segments(data) if not is_metadata(marker))
    coded = b"|".join(b",".join(b"%d:%d:%d" % t for t in mine) for mine in intervals)
    return b"".join(b for m, b in parts if not is_metadata(m) and m != 0xC4) + head + coded + tail
