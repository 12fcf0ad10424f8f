"""PDF streams: deflate streams packed anew in place, and the places of objects corrected, in a plain table or in a reference stream."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

from . import images
from .images import Unsupported
from .thorough import deflated

_STREAM = re.compile(rb"(\d+)(\s+\d+\s+obj\s*<<(?:(?!>>\s*stream|endobj).)*?/Length\s+)(\d+)((?:(?!>>\s*stream|endobj).)*?>>\s*stream\r?\n)", re.S)
_ROW = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
_START = re.compile(rb"(startxref\s+)(\d+)")
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_FLATE = re.compile(rb"/Filter\s*(?:/FlateDecode\b|\[\s*/FlateDecode\s*\])")
_REFERENCES = re.compile(rb"/Type\s*/XRef\b")


def _streams(data: bytes) -> Iterator[tuple[re.Match, bytes | None]]:
    """The streams whose length stands in their head, and what is deflated in them if that is all they do."""
    at = 0
    while m := _STREAM.search(data, at):
        at = m.end()
        if re.match(rb"\s+\d+\s+R\b", m[4]):
            continue
        raw, at = None, at + int(m[3])
        if _FLATE.search(m[2] + m[4]):
            try:
                raw = zlib.decompress(data[m.end() : at])
            except zlib.error:
                pass
        yield m, raw


def _entries(m: re.Match, raw: bytes | None) -> tuple[np.ndarray, list[int], bool]:
    """(kind, place, number) rows of a reference stream, the widths of its fields, and whether its rows are predicted."""
    head = m[2] + m[4]
    widths = re.search(rb"/W\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s*\]", head)
    predictor, columns = (int(v[1]) if (v := re.search(name + rb"\s+(\d+)", head)) else 1 for name in (rb"/Predictor", rb"/Columns"))
    if raw is None or not widths:
        raise Unsupported("reference stream")
    w = [int(n) for n in widths.groups()]
    predicted, stride = predictor >= 10, sum(w)
    if predictor not in (1, *range(10, 16)) or predicted and columns != stride or max(w) > 7 or not w[1] or len(raw) % (stride + predicted):
        raise Unsupported("reference stream")
    n, size, index = len(raw) // (stride + predicted), re.search(rb"/Size\s+(\d+)", head), re.search(rb"/Index\s*\[([\d\s]*)\]", head)
    if n != (sum(map(int, index[1].split()[1::2])) if index else int(size[1]) if size else -1):
        raise Unsupported("reference stream")
    rows = images._unfilter(raw, n, stride, 1) if predicted else np.frombuffer(raw, np.uint8).reshape(n, stride)
    out, at = np.zeros((n, 3), np.int64), 0
    out[:, 0] = not w[0]  # without a field for it, the kind is 1
    for i, width in enumerate(w):
        for byte in range(at, at + width):
            out[:, i] = out[:, i] << 8 | rows[:, byte]
        at += width
    return out, w, predicted


def recompressed(data: bytes, keep_metadata: bool = True) -> bytes:
    """Streams that only deflate compresses are deflated at the highest level where that is smaller, and the places of objects are
    corrected. Files with several updates, encryption or both kinds of references raise Unsupported."""
    if data.count(b"startxref") != 1 or b"/Encrypt" in data or b"/XRefStm" in data:
        raise Unsupported("PDF variant")
    edits: list[tuple[int, int, bytes]] = []
    references = None
    for m, raw in _streams(data):
        if _REFERENCES.search(m[2] + m[4]):
            if references:
                raise Unsupported("several reference streams")
            references = m, raw
        elif raw is not None:
            size, start, new = int(m[3]), m.end(), deflated(raw)
            if len(new) < size:
                edits += [(m.start(3), m.end(3), b"%d" % len(new)), (start, start + size, new)]
    ends, less = [b for _, b, _ in edits], [0, *accumulate(len(new) - (b - a) for a, b, new in edits)]

    def moved(at: int) -> int:
        return at + less[bisect.bisect_right(ends, at)]

    where = _START.search(data)
    start, table = int(where[2]), data.rfind(b"\nxref")
    if references:
        m, raw = references
        rows, w, predicted = _entries(m, raw)
        used = rows[:, 0] == 1
        if table >= 0 or m.start() != start or (rows[used, 1] > start).any() or not all(_OBJECT.match(data, at) for at in rows[used, 1].tolist()):
            raise Unsupported("references")
        rows[used, 1] = [moved(at) for at in rows[used, 1].tolist()]
        fields = [(rows[:, i, None] >> 8 * np.arange(width - 1, -1, -1) & 255).astype(np.uint8) for i, width in enumerate(w)]
        packed = np.ascontiguousarray(np.hstack(fields))
        new = deflated(images._filtered(packed, 1, 2) if predicted else packed.tobytes())
        edits += [(m.start(3), m.end(3), b"%d" % len(new)), (m.end(), m.end() + int(m[3]), new)]
    elif table < 0:
        raise Unsupported("no references")
    else:
        edits += [(r.start(1), r.end(1), b"%010d" % moved(int(r[1]))) for r in _ROW.finditer(data, table) if r[3] == b"n"]
    edits.append((where.start(2), where.end(2), b"%d" % moved(start)))
    out, done = [], 0
    for a, b, new in sorted(edits):
        out += [data[done:a], new]
        done = b
    return b"".join([*out, data[done:]])


def _target(data: bytes, at: int) -> bytes:
    """What lies at a place: an object's head, or a table."""
    m = _OBJECT.match(data, at)
    return b"%d %d" % (int(m[1]), int(m[2])) if m else data[at : at + 4]


def canonical(data: bytes) -> bytes:
    """Inflated streams, and everything outside of streams that isn't a length; instead of places, the objects that lie there."""
    out, done = [], 0
    for m, raw in _streams(data):
        size = int(m[3])
        out += [data[done : m.start(3)], b"#", m[4]]
        if raw is None:
            out.append(data[m.end() : m.end() + size])
        elif _REFERENCES.search(m[2] + m[4]):
            out += [_target(data, place) if kind == 1 else b"%d %d %d" % (kind, place, number) for kind, place, number in _entries(m, raw)[0].tolist()]
        else:
            out.append(b"%d:" % len(raw) + raw)
        done = m.end() + size
    table = max(done, data.rfind(b"\nxref"))
    tail = _ROW.sub(lambda r: r[0] if r[3] == b"f" else b"%b %b" % (_target(data, int(r[1])), r[2]), data[table:])
    tail = _START.sub(lambda s: s[1] + _target(data, int(s[2])), tail)
    return b"".join([*out, data[done:table], tail])
