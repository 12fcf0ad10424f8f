"""Lossless re-encoders and decoders of image files, in numpy and the standard library.

A decoder gives (width, height, RGBA bytes); an encoder gives a new file whose decoded pixels are the same. Files that can't be
re-encoded without loss (16-bit samples, unknown variants) raise Unsupported and stay as they are.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

Raster = tuple[int, int, np.ndarray]  # width, height, uint8 of shape (height, width, 4)


class Unsupported(ValueError):
    pass


# PNG

SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
#: Ancillary chunks that are kept with the metadata. Fixed values.
KEPT = (b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs", b"eXIf")


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise Unsupported("not a PNG")
    out, at = [], 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def _unfilter(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8)
    if len(rows) < height * (stride + 1):
        raise Unsupported("truncated PNG")
    rows = rows[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            for i in range(min(bpp, stride)):
                line[i::bpp] = np.cumsum(line[i::bpp], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for x in range(0, stride, bpp):
                left = line[x - bpp : x] if x else np.zeros(bpp, np.uint8)
                up = above[x : x + bpp]
                if kind == 3:
                    line[x : x + bpp] += ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
                else:
                    line[x : x + bpp] += _paeth(left, up, above[x - bpp : x] if x else np.zeros(bpp, np.uint8))
        elif kind:
            raise Unsupported("bad filter")
        out[y] = above = line
    return out


def decode_png(data: bytes) -> Raster:
    chunks = png_chunks(data)
    head = dict(chunks[:1]).get(b"IHDR")
    if head is None or len(head) != 13:
        raise Unsupported("no header")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if interlaced or depth == 16:
        raise Unsupported("interlaced or 16-bit PNG")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if samples is None or any(k == b"acTL" for k, _ in chunks):
        raise Unsupported("PNG variant")
    try:
        raw = zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT"))
    except zlib.error as e:
        raise Unsupported(str(e)) from e
    stride = (width * samples * depth + 7) // 8
    rows = _unfilter(raw, height, stride, max(1, samples * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :width]
    else:
        values = rows.reshape(height, width, samples)
    out = np.full((height, width, 4), 255, np.uint8)
    clear = next((b for k, b in chunks if k == b"tRNS"), None)
    if kind == 3:
        palette = np.frombuffer(next(b for k, b in chunks if k == b"PLTE"), np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        index = values.reshape(height, width)
        if index.size and index.max() >= len(palette):
            raise Unsupported("index outside palette")
        out[..., :3], out[..., 3] = palette[index], alpha[index]
    elif kind in (0, 4):
        gray = values.reshape(height, width, -1)
        level = gray[..., 0]
        if kind == 0 and clear:
            out[..., 3] = np.where(level == int.from_bytes(clear[:2], "big"), 0, 255)
        elif kind == 4:
            out[..., 3] = gray[..., 1]
        out[..., :3] = (level.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)[..., None]
    else:
        out[..., : samples] = values
        if kind == 2 and clear:
            key = np.array(struct.unpack(">HHH", clear[:6]), np.uint16)
            out[..., 3] = np.where((values == key).all(axis=2), 0, 255)
    return width, height, out


def _filtered(rows: np.ndarray, bpp: int, kind: int | None) -> bytes:
    """Rows with one filter for all, or (None) for each row that of least absolute sum."""
    height, stride = rows.shape
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    options = [rows, rows - left, rows - up, rows - ((left.astype(np.uint16) + up) // 2).astype(np.uint8), rows - _paeth(left, up, corner)]
    if kind is None:
        cost = np.stack([abs(o.view(np.int8).astype(np.int32)).sum(axis=1) for o in options])
        pick = cost.argmin(axis=0)
    else:
        pick = np.full(height, kind)
    body = np.empty((height, stride + 1), np.uint8)
    body[:, 0] = pick
    for y in range(height):
        body[y, 1:] = options[pick[y]][y]
    return body.tobytes()


def encode_png(data: bytes, keep_metadata: bool = True) -> bytes:
    """Colour type narrowed as far as the pixels allow (palette, gray, gray with alpha, RGB, RGBA), the best of several filters,
    deflate at its highest level."""
    width, height, pixels = decode_png(data)
    if not width or not height:
        raise Unsupported("empty PNG")
    packed = pixels.reshape(-1, 4).view("<u4").ravel()
    colours, first, index = np.unique(packed, return_index=True, return_inverse=True)
    opaque, gray = (pixels[..., 3] == 255).all(), (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 1] == pixels[..., 2]).all()
    options = []  # colour type, depth, rows, bytes of a pixel, palette chunks
    if len(colours) <= 256:
        order = np.argsort(first)  # by first appearance
        table, place = colours[order].view(np.uint8).reshape(-1, 4), np.empty(len(order), int)
        place[order] = np.arange(len(order))
        rows = place[index].astype(np.uint8).reshape(height, width)
        depth = next(d for d in (1, 2, 4, 8) if len(colours) <= 1 << d)
        if depth < 8:
            bits = (rows[..., None] >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.reshape(height, -1).astype(np.uint8), axis=1)
        options.append((3, depth, rows, 1, _chunk(b"PLTE", table[:, :3].tobytes()) + (b"" if opaque else _chunk(b"tRNS", table[:, 3].tobytes()))))
    if gray:
        options.append((0, 8, pixels[..., [0]], 1, b"") if opaque else (4, 8, pixels[..., [0, 3]], 2, b""))
    else:
        options.append((2, 8, pixels[..., :3], 3, b"") if opaque else (6, 8, pixels, 4, b""))
    tried = []
    for kind, depth, rows, bpp, extra in options:
        rows = np.ascontiguousarray(rows).reshape(height, -1)
        best = min((zlib.compress(_filtered(rows, bpp, f), 9) for f in (0, 1, 2, 4, None)), key=len)
        tried.append((len(best) + len(extra), kind, depth, extra, best))
    _, kind, depth, extra, best = min(tried, key=lambda t: t[0])
    kept = b"".join(_chunk(k, b) for k, b in png_chunks(data) if k in KEPT) if keep_metadata else b""
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + kept + extra + _chunk(b"IDAT", best) + _chunk(b"IEND", b"")


# PNM

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_pnm(data: bytes) -> Raster:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise Unsupported("not a PNM")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise Unsupported("bad PNM header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    if top > 255:
        raise Unsupported("16-bit PNM")
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    if kind == b"P4":
        values = np.unpackbits(np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1), axis=1)[:, :width].ravel()
    elif kind in (b"P5", b"P6"):
        values = np.frombuffer(data, np.uint8, n, at + 1)
    else:
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", text) if kind == b"P1" else text.split())][:n], np.uint8)
    if len(values) < n:
        raise Unsupported("truncated PNM")
    values = 1 - values if kind in (b"P1", b"P4") else values
    values = (values.astype(np.uint16) * 255 // top).astype(np.uint8) if top != 255 else values
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = values.reshape(height, width, planes)
    return width, height, out


def encode_pnm(data: bytes, keep_metadata: bool = True) -> bytes:
    """Binary with 8 bits; gray stays gray. Other maximum values than 255 would lose the scale, so they stay as they are."""
    kind = data[:2]
    width, height, pixels = decode_pnm(data)
    if kind in (b"P1", b"P4"):
        bits = np.packbits(pixels[..., 0] == 0, axis=1)
        return b"P4\n%d %d\n" % (width, height) + bits.tobytes()
    top = int(re.match(rb"P\d(?:(?:\s|#[^\n]*\n)*\d+){2}(?:\s|#[^\n]*\n)*(\d+)", data)[1])
    if top != 255:
        raise Unsupported("maximum value other than 255")
    if kind in (b"P2", b"P5"):
        return b"P5\n%d %d\n255\n" % (width, height) + pixels[..., 0].tobytes()
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels[..., :3]).tobytes()


# TGA


def decode_tga(data: bytes) -> Raster:
    if len(data) < 18:
        raise Unsupported("not a TGA")
    note, mapped, kind = data[0], data[1], data[2]
    width, height, bits, flags = *struct.unpack_from("<HH", data, 12), data[16], data[17]
    if mapped or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32) or (kind & 7 == 3) != (bits == 8) or flags & 0xC0:
        raise Unsupported("TGA variant")
    size, at, n = bits // 8, 18 + note, width * height
    if kind < 8:
        body = np.frombuffer(data, np.uint8, n * size, at)
    else:
        out, left = [], n
        while left > 0:
            head = data[at]
            count = (head & 0x7F) + 1
            if head & 0x80:
                out.append(data[at + 1 : at + 1 + size] * count)
                at += 1 + size
            else:
                out.append(data[at + 1 : at + 1 + size * count])
                at += 1 + size * count
            left -= count
        body = np.frombuffer(b"".join(out), np.uint8)[: n * size]
    rows = body.reshape(height, width, size)
    if not flags & 0x20:
        rows = rows[::-1]
    if flags & 0x10:
        rows = rows[:, ::-1]
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = rows[..., [0, 0, 0]] if size == 1 else rows[..., 2::-1]
    if size == 4:
        out[..., 3] = rows[..., 3]
    return width, height, out


def _packets(rows: np.ndarray, most: int = 128) -> bytes:
    """Run-length packets of pixels, within each row."""
    out = bytearray()
    for row in rows:
        n, x = len(row), 0
        same = np.r_[(row[1:] == row[:-1]).all(axis=1), False]
        while x < n:
            run = 1
            while x + run < n and run < most and same[x + run - 1]:
                run += 1
            if run > 1:
                out.append(0x80 | run - 1)
                out += row[x].tobytes()
                x += run
                continue
            end = x + 1
            while end < n and end - x < most and not (same[end] if end < n - 1 else False):
                end += 1
            out.append(end - x - 1)
            out += row[x:end].tobytes()
            x = end
    return bytes(out)


def encode_tga(data: bytes, keep_metadata: bool = True) -> bytes:
    width, height, pixels = decode_tga(data)
    size = data[16] // 8
    rows = pixels[..., [0]] if size == 1 else pixels[..., [2, 1, 0, 3][:size]]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 11 if size == 1 else 10, 0, 0, 0, 0, 0, width, height, 8 * size, 0x20 | (8 if size == 4 else 0))
    return head + _packets(np.ascontiguousarray(rows))


# BMP


def _bmp_head(data: bytes) -> tuple[int, int, int, int, int, int, bool, np.ndarray]:
    if data[:2] != b"BM" or len(data) < 54:
        raise Unsupported("not a BMP")
    start, size = struct.unpack_from("<II", data, 10)
    width, height, planes, bits, method = struct.unpack_from("<iiHHI", data, 18)
    if size < 40 or planes != 1 or width <= 0 or method not in (0, 1, 2) or bits not in (4, 8, 24) or {1: 8, 2: 4}.get(method, bits) != bits:
        raise Unsupported("BMP variant")
    used = struct.unpack_from("<I", data, 46)[0] or (1 << bits if bits <= 8 else 0)
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4) if bits <= 8 else np.zeros((0, 4), np.uint8)
    return start, size, width, abs(height), bits, method, height < 0, palette


def _bmp_index(data: bytes) -> np.ndarray:
    start, _, width, height, bits, method, _, _ = _bmp_head(data)
    if method == 0:
        stride = (width * bits + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
        return rows[:, :width] if bits == 8 else np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)[:, :width]
    out, x, y, at = np.zeros((height, width), np.uint8), 0, 0, start
    while at + 1 < len(data):
        count, value = data[at], data[at + 1]
        at += 2
        if count:
            line = [value] * count if bits == 8 else [value >> 4 if i % 2 == 0 else value & 15 for i in range(count)]
        elif value == 0:
            x, y = 0, y + 1
            continue
        elif value == 1:
            break
        elif value == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
            continue
        else:
            size = value if bits == 8 else (value + 1) // 2
            part = data[at : at + size]
            line = list(part) if bits == 8 else [p for b in part for p in (b >> 4, b & 15)][:value]
            at += size + (size & 1)
        if y >= height or x + len(line) > width:
            raise Unsupported("BMP run leaves the image")
        out[y, x : x + len(line)] = line
        x += len(line)
    return out


def decode_bmp(data: bytes) -> Raster:
    start, _, width, height, bits, _, top_down, palette = _bmp_head(data)
    out = np.full((height, width, 4), 255, np.uint8)
    if bits == 24:
        stride = (3 * width + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : 3 * width].reshape(height, width, 3)
        out[..., :3] = rows[..., ::-1]
    else:
        index = _bmp_index(data)
        if index.max(initial=0) >= len(palette):
            raise Unsupported("index outside palette")
        out[..., :3] = palette[index][..., 2::-1]
    return width, height, out if top_down else out[::-1]


def encode_bmp(data: bytes, keep_metadata: bool = True) -> bytes:
    """Images of 8 bits, or of 24 bits with at most 256 colours, in RLE8 or plain with a palette, if that is smaller; others as they are."""
    _, size, width, height, bits, _, top_down, palette = _bmp_head(data)
    if bits == 24:
        pixels = decode_bmp(data)[2]  # rows from the top
        packed = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]]).reshape(-1, 4).view("<u4").ravel() & 0xFFFFFF
        colours, index = np.unique(packed, return_inverse=True)
        if len(colours) > 256:
            return data
        head = bytearray(data[14 : 14 + size])
        struct.pack_into("<H", head, 14, 8)
        made = [_bmp_indexed(head, size, width, height, colours.astype("<u4").view(np.uint8).reshape(-1, 4), index.reshape(height, width)[::-1].astype(np.uint8), m) for m in (0, 1)]
        return min([data, *made], key=len)
    if bits != 8:
        return data
    index = _bmp_index(data)
    index = index[::-1] if top_down else index
    return min((_bmp_indexed(bytearray(data[14 : 14 + size]), size, width, height, palette, index, m) for m in (0, 1)), key=len)


def _bmp_indexed(head: bytearray, size: int, width: int, height: int, palette: np.ndarray, index: np.ndarray, method: int) -> bytes:
    """A file of 8-bit rows from the bottom up, in RLE8 (method 1) or plain."""
    body = _rle8(index) if method else b"".join(r.tobytes().ljust((width + 3) // 4 * 4, b"\0") for r in index)
    start = 14 + size + 4 * len(palette)
    struct.pack_into("<i", head, 8, height)
    struct.pack_into("<II", head, 16, method, len(body))
    struct.pack_into("<I", head, 32, len(palette))
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + bytes(head) + palette.tobytes() + body


def _rle8(index: np.ndarray) -> bytes:
    body = bytearray()
    for row in index:
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(b - a)
            while n > 0:
                body += bytes((min(n, 255), int(row[a])))
                n -= 255
        body += b"\0\0"
    body[-2:] = b"\0\1"
    return bytes(body)


# GIF


def _gif_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _lzw_decode(data: bytes, least: int, n: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, size, bits, held, last, total = [], least + 1, 0, 0, b"", 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code = held & (1 << size) - 1
            held >>= size
            bits -= size
            if code == clear:
                table = [bytes((i,)) for i in range(clear)] + [b"", b""]
                size, last = least + 1, b""
                continue
            if code == end or not table:
                return b"".join(out)[:n]
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            total += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
            if total >= n:
                return b"".join(out)[:n]
    return b"".join(out)[:n]


def _lzw_encode(data: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    out, held, bits, size = bytearray(), clear, least + 1, least + 1
    table: dict[tuple[int, int], int] = {}
    free, code = end + 1, data[0]

    def flush() -> None:
        nonlocal held, bits
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    for byte in data[1:]:
        if (known := table.get((code, byte))) is not None:
            code = known
            continue
        held |= code << bits
        bits += size
        flush()
        if free < 4096:
            table[code, byte] = free
            if free == 1 << size and size < 12:
                size += 1
            free += 1
        else:
            held |= clear << bits
            bits += size
            flush()
            table, free, size = {}, end + 1, least + 1
        code = byte
    for last in (code, end):
        held |= last << bits
        bits += size
        if last == code and free == 1 << size and size < 12:
            size += 1
        flush()
    if bits:
        out.append(held & 255)
    return bytes(out)


def gif_parts(data: bytes) -> list[tuple[str, bytes, bytes]]:
    """(kind, header bytes, body) of a GIF: its start, extensions, images (body: decoded indices) and trailer."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Unsupported("not a GIF")
    flags = data[10]
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    out = [("start", data[:at], b"")]
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            _, stop = _gif_blocks(data, at + 2)
            out.append(("comment" if data[at + 1] == 0xFE else "extension", data[at:stop], b""))
            at = stop
        elif kind == 0x2C:
            width, height, local = *struct.unpack_from("<HH", data, at + 5), data[at + 9]
            stop = at + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            body, after = _gif_blocks(data, stop + 1)
            index = _lzw_decode(body, data[stop], width * height)
            if len(index) < width * height:
                raise Unsupported("truncated GIF")
            out.append(("image", data[at : stop + 1], index))
            at = after
        elif kind == 0x3B:
            return [*out, ("end", b";", b"")]
        else:
            raise Unsupported("bad GIF block")
    raise Unsupported("GIF without trailer")


def encode_gif(data: bytes, keep_metadata: bool = True) -> bytes:
    """The same blocks with the images' codes packed anew; comments go without metadata."""
    out = []
    for kind, head, body in gif_parts(data):
        if kind == "comment" and not keep_metadata:
            continue
        out.append(head)
        if kind == "image":
            codes = _lzw_encode(body, head[-1]) if body else b""
            out += [bytes((len(p),)) + p for p in (codes[i : i + 255] for i in range(0, len(codes), 255))]
            out.append(b"\0")
    return b"".join(out)


def gif_frames(data: bytes) -> bytes:
    """What must be equal for two GIFs to show the same: all but comments and the packing of codes."""
    return b"".join(head + body for kind, head, body in gif_parts(data) if kind != "comment")
