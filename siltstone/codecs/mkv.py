"""Matroska and WebM files without padding: filling elements and checksums go, sizes take as few bytes as they need, and positions follow.

Clusters keep their bytes, so places inside them stay right. Files whose elements don't tell their size (live streams) raise Unsupported.
"""

from __future__ import annotations

from collections.abc import Iterator

from .images import Unsupported

HEADER, SEGMENT, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1F43B675
FILLING = frozenset((0xEC, 0xBF))  # Void, CRC-32
#: Elements that hold elements, outside of clusters. Fixed values.
MASTERS = frozenset((0x114D9B74, 0x4DBB, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x6D80, 0x6240, 0x5034, 0x5035, 0x1C53BB6B, 0xBB, 0xB7, 0x1941A469, 0x61A7, 0x1043A770, 0x45B9, 0xB6, 0x80, 0x1254C367, 0x7373, 0x63C0, 0x67C8))
#: Elements whose number is a place in the segment: of a seek entry, of a cue.
POSITIONS = frozenset((0x53AC, 0xF1))


def _elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body's start, end) of each element."""
    at = start
    while at < end:
        n = 9 - data[at].bit_length()
        if n > 4 or at + n >= end:
            raise Unsupported("bad element")
        m = 9 - data[at + n].bit_length()
        if m > 8:
            raise Unsupported("bad size")
        size = int.from_bytes(data[at + n : at + n + m], "big") & (1 << 7 * m) - 1
        if size == (1 << 7 * m) - 1:
            raise Unsupported("unknown size")
        body = at + n + m
        if body + size > end:
            raise Unsupported("truncated file")
        yield int.from_bytes(data[at : at + n], "big"), at, body, body + size
        at = body + size


def _size(n: int) -> bytes:
    m = next(m for m in range(1, 9) if n < (1 << 7 * m) - 1)
    return (n | 1 << 7 * m).to_bytes(m, "big")


def _whole(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _clean(data: bytes, start: int, end: int, move) -> bytes:
    out = []
    for kind, _, body, stop in _elements(data, start, end):
        if kind in FILLING:
            continue
        if kind in POSITIONS:
            value = int.from_bytes(data[body:stop], "big")
            out.append(_whole(kind, move(value, stop - body)))
        else:
            out.append(_whole(kind, _clean(data, body, stop, move) if kind in MASTERS else data[body:stop]))
    return b"".join(out)


def _segment(data: bytes) -> tuple[bytes, list[tuple[int, int, int, int]], int, bytes]:
    """What comes before, the segment's children, where its body begins, and what comes after."""
    for kind, at, body, stop in _elements(data, 0, len(data)):
        if kind == SEGMENT:
            return data[:at], list(_elements(data, body, stop)), body, data[stop:]
    raise Unsupported("no segment")


def cleaned(data: bytes, keep_metadata: bool = True) -> bytes:
    before, children, base, after = _segment(data)
    if not data.startswith(HEADER.to_bytes(4, "big")):
        raise Unsupported("not a Matroska file")
    kept = [c for c in children if c[0] not in FILLING]

    def made(move) -> list[bytes]:
        return [_whole(kind, _clean(data, body, stop, move) if kind in MASTERS else data[body:stop]) for kind, _, body, stop in kept]

    # numbers keep their width, so a first pass tells where everything will be
    places, at = {}, 0
    for (_, start, _, _), part in zip(kept, made(lambda v, n: bytes(n)), strict=True):
        places[start - base] = at
        at += len(part)

    def move(value: int, width: int) -> bytes:
        if value not in places:
            raise Unsupported("a position that no element has")
        return places[value].to_bytes(width, "big")

    return before + _whole(SEGMENT, b"".join(made(move))) + after


def canonical(data: bytes) -> bytes:
    """All elements but filling, with positions told as the number of the child that they lead to."""
    before, children, base, after = _segment(data)
    kept = [c for c in children if c[0] not in FILLING]
    number = {start - base: i for i, (_, start, _, _) in enumerate(kept)}
    move = lambda v, n: b"#%d" % number.get(v, -1)
    return before + b"".join(_whole(kind, _clean(data, body, stop, move) if kind in MASTERS else data[body:stop]) for kind, _, body, stop in kept) + after
