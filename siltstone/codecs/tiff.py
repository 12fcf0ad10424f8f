"""TIFF files: every page decoded to RGBA, and packed anew with deflate and horizontal prediction."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .images import Raster, Unsupported

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Tags that are kept with the metadata: texts, resolution, XMP, colour profile. Fixed values.
KEPT = (270, 271, 272, 282, 283, 296, 305, 306, 315, 700, 34675)

Tags = dict[int, tuple[int, bytes, tuple]]  # tag → type, raw value, numbers


def directories(data: bytes) -> tuple[str, list[Tags]]:
    """The byte order, and the tags of each page."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise Unsupported("not a TIFF")
    (at,), out, seen = struct.unpack_from(order + "I", data, 4), [], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise Unsupported("bad TIFF directory")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: Tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            start = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            raw = data[start : start + size]
            tags[tag] = kind, raw, struct.unpack(f"{order}{count}{_CODES[kind]}", raw) if kind in _CODES else ()
        out.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return order, out


def _lzw(data: bytes) -> bytes:
    """Codes from the highest bit down, widened one entry early."""
    out, held, bits, size = [], 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        code, bits = held >> bits - size, bits - size
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, size = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code >= len(table) + (1 if last else 0):
            raise Unsupported("bad LZW code")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        size = max(size, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n == 128:
            at += 1
        else:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


def _unpacked(body: bytes, compression: int) -> bytes:
    if compression in (8, 32946):
        return zlib.decompress(body)
    if compression in (1, 5, 32773):
        return {1: bytes, 5: _lzw, 32773: _packbits}[compression](body)
    raise Unsupported(f"TIFF compression {compression}")


def _page(data: bytes, tags: Tags) -> Raster:
    get = lambda tag, default: tags[tag][2][0] if tag in tags and tags[tag][2] else default
    width, height, depth, samples = get(256, 0), get(257, 0), get(258, 1), get(277, 1)
    kind, compression, predictor = get(262, 0), get(259, 1), get(317, 1)
    if not width or not height or depth not in (1, 4, 8) or (depth < 8 and samples > 1) or get(284, 1) != 1 and samples > 1 or kind not in (0, 1, 2, 3) or predictor not in (1, 2) or len(set(tags.get(258, (0, 0, (depth,)))[2])) > 1:
        raise Unsupported("TIFF variant")
    if 322 in tags:
        across, down, places, sizes = get(322, width), get(323, height), tags[324][2], tags[325][2]
    else:
        across, down, places, sizes = width, min(get(278, height), height), tags[273][2], tags[279][2]
    values = np.zeros((height, width, samples), np.uint8)
    columns = -(-width // across)
    for i, (start, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = i // columns * down, i % columns * across
        rows = down if 322 in tags else min(down, height - top)
        stride = (across * samples * depth + 7) // 8
        raw = np.frombuffer(_unpacked(data[start : start + size], compression), np.uint8)
        if len(raw) < rows * stride:
            raise Unsupported("truncated TIFF")
        block = raw[: rows * stride].reshape(rows, stride)
        if depth < 8:
            bits = np.unpackbits(block, axis=1).reshape(rows, -1, depth)
            block = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :across]
        block = block.reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = values[top : top + rows, left : left + across]
        part[...] = block[: part.shape[0], : part.shape[1]]
    out = np.full((height, width, 4), 255, np.uint8)
    colours = 3 if kind == 2 else 1
    if samples not in (colours, colours + 1):
        raise Unsupported("TIFF samples")
    if kind == 3:
        table = np.array(tags[320][2]).reshape(3, -1) >> 8
        out[..., :3] = table.T[values[..., 0]]
    elif kind == 2:
        out[..., :3] = values[..., :3]
    else:
        gray = (values[..., 0].astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        out[..., :3] = (255 - gray if kind == 0 else gray)[..., None]
    if samples > colours:
        out[..., 3] = values[..., colours]
    return width, height, out


def decode(data: bytes) -> list[Raster]:
    try:
        return [_page(data, tags) for tags in directories(data)[1]]
    except (KeyError, struct.error, zlib.error, IndexError) as e:
        raise Unsupported(f"TIFF: {e}") from e


def write(pages: list[tuple[Raster, Tags, str]]) -> bytes:
    """A little-endian file. Pages of one gray level without transparency have one sample, others three, or four with alpha."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for (width, height, pixels), kept, order in pages:
        opaque = (pixels[..., 3] == 255).all()
        gray = opaque and (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 1] == pixels[..., 2]).all()
        rows = pixels[..., :1] if gray else pixels[..., :3] if opaque else pixels
        samples = rows.shape[2]
        step = np.diff(rows, axis=1, prepend=np.zeros((height, 1, samples), np.uint8)).astype(np.uint8)
        predictor, body = min(((p, zlib.compress(r.tobytes(), 9)) for p, r in ((2, step), (1, rows))), key=lambda x: len(x[1]))
        start = len(out)
        out += body + b"\0" * (len(body) & 1)
        short = lambda *v: (3, struct.pack(f"<{len(v)}H", *v), len(v))
        long = lambda v: (4, struct.pack("<I", v), 1)
        entries = {256: long(width), 257: long(height), 258: short(*[8] * samples), 259: short(8), 262: short(1 if gray else 2), 273: long(start), 277: short(samples), 278: long(height), 279: long(len(body)), 284: short(1), 317: short(predictor)}
        if samples == 4:
            entries[338] = short(2)
        for tag, (kind, raw, numbers) in kept.items():
            count = len(raw) // _SIZES[kind]
            if kind in _CODES:
                raw = struct.pack(f"<{count}{_CODES[kind]}", *numbers)
            elif order == ">":  # fractions, of two numbers each
                raw = struct.pack(f"<{2 * count}I", *struct.unpack(f">{2 * count}I", raw))
            entries[tag] = kind, raw, count
        head = bytearray(struct.pack("<H", len(entries)))
        for tag, (kind, raw, count) in sorted(entries.items()):
            if len(raw) <= 4:
                place = raw.ljust(4, b"\0")
            else:
                place = struct.pack("<I", len(out))
                out += raw + b"\0" * (len(raw) & 1)
            head += struct.pack("<HHI", tag, kind, count) + place
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + len(head)
        out += head + b"\0\0\0\0"
    return bytes(out)


def encode(data: bytes, keep_metadata: bool = True) -> bytes:
    order, tags = directories(data)
    kept = [{t: v for t, v in page.items() if keep_metadata and t in KEPT and v[0] in _SIZES} for page in tags]
    return write(list(zip(decode(data), kept, [order] * len(kept), strict=True)))


def canonical(data: bytes) -> bytes:
    return b"".join(b"%d %d " % (w, h) + p.tobytes() for w, h, p in decode(data))
