"""Small files of each kind, written plainly: what queries and tests give to the readers and encoders."""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib

import numpy as np

from . import audio, flac, images, jpeg, tiff, webp


def image(kind: str, pixels: np.ndarray) -> bytes:
    """A file of the kind with these RGB pixels of shape (height, width, 3), packed badly."""
    height, width, _ = pixels.shape
    if kind in ("png", "zopflipng"):
        body = zlib.compress(images._filtered(np.ascontiguousarray(pixels).reshape(height, -1), 3, 0), 0)
        return images.SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + images._chunk(b"IDAT", body) + images._chunk(b"IEND", b"")
    if kind == "pnm":
        return b"P3\n%d %d\n255\n" % (width, height) + b" ".join(b"%d" % v for v in pixels.ravel().tolist())
    if kind == "tga":
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 24, 0x20) + np.ascontiguousarray(pixels[..., ::-1]).tobytes()
    if kind == "bmp":
        rows = b"".join(r[:, ::-1].tobytes().ljust((3 * width + 3) // 4 * 4, b"\0") for r in np.ascontiguousarray(pixels)[::-1])
        return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    if kind in ("gif", "flexigif"):
        gray = np.ascontiguousarray(pixels[..., 0]).tobytes()
        table = bytes(v for i in range(256) for v in (i, i, i))
        codes = images._lzw_encode(gray, 8)
        parts = b"".join(bytes((len(p),)) + p for p in (codes[i : i + 40] for i in range(0, len(codes), 40)))
        return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + table + b"," + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + parts + b"\0;"
    if kind == "webp":
        return webp.plain(np.dstack([pixels, np.full((height, width), 255, np.uint8)]))
    if kind == "tiff":
        alpha = np.dstack([pixels, np.full((height, width), 255, np.uint8)])
        plain = tiff.write([((width, height, alpha), {}, "<")])
        (tags,) = tiff.directories(plain)[1]
        samples = tags[277][2][0]
        raw = np.ascontiguousarray(pixels[..., :samples]).tobytes()
        entries = sorted({256: (4, width), 257: (4, height), 258: (3, 8), 259: (3, 1), 262: (3, 1 if samples == 1 else 2), 273: (4, 8), 277: (3, samples), 278: (4, height), 279: (4, len(raw))}.items())
        if samples == 3:  # three numbers don't fit into the entry
            raw += struct.pack("<HHH", 8, 8, 8)
        head = struct.pack("<H", len(entries))
        for tag, (code, value) in entries:
            place = (3, 8 + len(raw) - 6) if tag == 258 and samples == 3 else (1, value)
            head += struct.pack("<HHII", tag, code, *place)
        return b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + head + b"\0\0\0\0"
    raise ValueError(kind)


def zip_file(members: list[tuple[str, bytes]], stored: bool = True) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED, 9)
    return buffer.getvalue()


def pdf_file(content: bytes, kind: bytes = b"/Type /Metadata") -> bytes:
    """One deflated stream, as object 4, and a plain table."""
    body = zlib.compress(content, 1)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< " + kind + b" /Filter /FlateDecode /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"xref\n0 5\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size 5 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def pdf_with_references(content: bytes, predicted: bool = True) -> bytes:
    """The same file as current writers make it: page tree in an object stream (5), places in a reference stream (6)."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
    starts = [sum(len(o) + 1 for o in objects[:i]) for i in range(3)]
    first = b" ".join(b"%d %d" % (i + 1, at) for i, at in enumerate(starts)) + b"\n"
    out, places = b"%PDF-1.5\n", {}

    def stream(number: int, head: bytes, raw: bytes) -> bytes:
        places[number] = len(out)
        body = zlib.compress(raw, 1)
        return out + b"%d 0 obj\n<< %b /Filter /FlateDecode /Length %d >>\nstream\n" % (number, head, len(body)) + body + b"\nendstream\nendobj\n"

    out = stream(4, b"", content)
    out = stream(5, b"/Type /ObjStm /N 3 /First %d" % len(first), first + b"\n".join(objects))
    places[6] = len(out)
    rows = [(0, 0, 255), *((2, 5, i) for i in range(3)), *((1, places[n], 0) for n in (4, 5, 6))]
    table = np.frombuffer(b"".join(struct.pack(">BIB", *r) for r in rows), np.uint8).reshape(7, 6)
    how = b"/DecodeParms << /Columns 6 /Predictor 12 >> " if predicted else b""
    out = stream(6, b"/Type /XRef /Size 7 /W [1 4 1] /Root 1 0 R " + how, images._filtered(table, 1, 2) if predicted else table.tobytes())
    return out + b"startxref\n%d\n%%%%EOF\n" % places[6]


SOUNDS = ("flac", "mp3", "wav", "aiff", "ape", "mp4", "ogg")


def picture_block(picture: bytes, mime: bytes = b"image/png", kind: int = 3, text: bytes = b"d") -> bytes:
    return struct.pack(">II", kind, len(mime)) + mime + struct.pack(">I", len(text)) + text + struct.pack(">IIII", 1, 1, 8, 0) + struct.pack(">I", len(picture)) + picture


def _tag(picture: bytes) -> bytes:
    spread = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    body = b"\0image/png\0\3d\0" + picture
    frame = b"APIC" + len(body).to_bytes(4, "big") + b"\0\0" + body
    return b"ID3\3\0\0" + spread(len(frame)) + frame


def sound(kind: str, picture: bytes) -> bytes:
    """A file of the kind with one front cover."""
    if kind == "flac":
        return flac.write(flac.Sound(8000, 16, np.arange(100)[:, None], [(flac.PICTURE, picture_block(picture))]))
    if kind == "mp3":
        return _tag(picture) + b"\xff\xfbsound"
    if kind in ("wav", "aiff"):
        order, head, form, name = ("<", b"RIFF", b"WAVE", b"id3 ") if kind == "wav" else (">", b"FORM", b"AIFF", b"ID3 ")
        tag = _tag(picture)
        body = form + b"data" + struct.pack(order + "I", 3) + b"abc\0" + name + struct.pack(order + "I", len(tag)) + tag + b"\0" * (len(tag) & 1)
        return head + struct.pack(order + "I", len(body)) + body
    if kind == "ape":
        item = struct.pack("<II", len(picture) + 2, 2) + b"Cover Art (Front)\0d\0" + picture
        return b"MAC sound" + item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    if kind == "mp4":
        atom = lambda n, b: struct.pack(">I", 8 + len(b)) + n + b
        covers = atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", atom(b"covr", atom(b"data", struct.pack(">II", 14, 0) + picture)))))
        moov = lambda at: atom(b"moov", atom(b"trak", atom(b"mdia", atom(b"minf", atom(b"stbl", atom(b"stco", bytes(4) + struct.pack(">II", 1, at)))))) + covers)
        start = atom(b"ftyp", b"M4A ")
        return start + moov(len(start) + len(moov(0)) + 8) + atom(b"mdat", b"SAMPLES!")
    if kind == "ogg":
        comments = [b"A=b", b"METADATA_BLOCK_PICTURE=" + base64.b64encode(picture_block(picture))]
        tags = b"\x03vorbis" + struct.pack("<I", 1) + b"v" + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments) + b"\1"
        packets = [(b"\x01vorbis" + bytes(20), 0), (tags, 0), (b"\x05vorbis" + bytes(700), 0), *((bytes((i,)) * (100 + i), 100 * (i + 1)) for i in range(20))]
        out, number = [], 0
        for i, (packet, position) in enumerate(packets):
            lacing, at = [255] * (len(packet) // 255) + [len(packet) % 255], 0
            while at < len(lacing):
                part = lacing[at : at + 255]
                start = sum(lacing[:at])
                flags = (1 if at else 0) | (2 if not number else 0) | (4 if i == len(packets) - 1 else 0)
                out.append(audio._page(flags, position if at + 255 >= len(lacing) else -1, 7, number, part, packet[start : start + sum(part)]))
                number, at = number + 1, at + 255
        return b"".join(out)
    raise ValueError(kind)


def seismic_file(samples: list[int]) -> bytes:
    """One record of plain 32-bit integers."""
    size = 1 << max(8, (64 + 4 * len(samples) - 1).bit_length())
    head = b"000001D %-5s%-2s%-3s%-2s" % (b"STA", b"00", b"BHZ", b"XX") + struct.pack(">HHBBBBHHhhBBBBiHH", 2024, 5, 1, 2, 3, 0, 0, len(samples), 20, 1, 0, 0, 0, 1, 0, 64, 48) + struct.pack(">HHBBBB", 1000, 0, 3, 1, size.bit_length() - 1, 0)
    return (head.ljust(64, b"\0") + struct.pack(f">{len(samples)}i", *samples)).ljust(size, b"\0")


def video(text: bytes, padding: int = 100) -> bytes:
    """A Matroska file with filling, one cluster, and a seek entry and a cue that lead to it."""
    from .mkv import _whole

    wide = lambda kind, body: kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body
    cluster = wide(0x1F43B675, _whole(0xE7, b"\0") + _whole(0xA3, text))
    info, void = wide(0x1549A966, _whole(0xBF, bytes(4)) + _whole(0x2AD7B1, b"\x0f\x42\x40")), wide(0xEC, bytes(padding))
    seek = lambda at: wide(0x114D9B74, wide(0x4DBB, _whole(0x53AB, b"\x1f\x43\xb6\x75") + _whole(0x53AC, at.to_bytes(4, "big"))))
    cues = lambda at: wide(0x1C53BB6B, wide(0xBB, _whole(0xB3, b"\0") + wide(0xB7, _whole(0xF7, b"\1") + _whole(0xF1, at.to_bytes(4, "big")))))
    at = len(seek(0)) + len(void) + len(info)
    return wide(0x1A45DFA3, _whole(0x4282, b"matroska")) + wide(0x18538067, seek(at) + void + info + cluster + cues(at))


def jpeg_file(width: int, height: int, seed: int, components: int = 1, interval: int = 0) -> bytes:
    """Coefficients by chance, in codes of eight bits, with a comment given twice."""
    rng = np.random.default_rng(seed)
    part = lambda m, b: bytes((0xFF, m)) + (len(b) + 2).to_bytes(2, "big") + b
    shape = b"".join(bytes((i + 1, 0x22 if i == 0 and components == 3 else 0x11, 0)) for i in range(components))
    parts = [(0xD8, b"\xff\xd8"), (0xFE, part(0xFE, b"hello")), (0xFE, part(0xFE, b"hello")), (0xDB, part(0xDB, bytes(1) + b"\1" * 64)), (0xC0, part(0xC0, b"\x08" + struct.pack(">HHB", height, width, components) + shape))]
    if interval:
        parts.append((0xDD, part(0xDD, struct.pack(">H", interval))))
    head = part(0xDA, bytes((components,)) + b"".join(bytes((i + 1, 0)) for i in range(components)) + b"\0\x3f\0")
    unit, intervals, mine = (16 if components == 3 else 8), [], []
    for u in range(-(-width // unit) * -(-height // unit)):
        if interval and u and u % interval == 0:
            intervals.append(mine)
            mine = []
        for _ in range(6 if components == 3 else 1):
            size = int(rng.integers(0, 6))
            mine.append((0, size, int(rng.integers(0, 1 << size))))
            k = 1
            while k < 64:
                run, size = int(rng.integers(0, 4)), int(rng.integers(1, 4))
                if rng.random() < 0.3 or k + run > 63:
                    mine.append((16, 0, 0))
                    break
                mine.append((16, run << 4 | size, int(rng.integers(0, 1 << size))))
                k += run + 1
    flat = lambda symbols: ((0,) * 7 + (len(symbols),) + (0,) * 8, bytes(symbols))
    tables = {0: flat(range(12)), 16: flat(sorted({0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)}))}
    return jpeg.write(parts, head, [*intervals, mine], b"\xff\xd9", tables)
