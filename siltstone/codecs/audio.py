"""Sound files as containers of embedded pictures: reading them out and putting others in their place; Ogg pages."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

from .containers import _picture_block, flac_pictures, id3_pictures, mp4_covers
from .images import Unsupported

Picture = tuple[int, str, str, bytes]  # kind, content type, description, bytes
Change = Callable[[bytes], bytes]  # from a picture to the one in its place, asked for in order


def image_type(data: bytes) -> str:
    """The content type by the first bytes, as far as covers go; empty if untold."""
    for head, mime in ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp")):
        if data.startswith(head):
            return mime
    return "image/webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else ""


def _riff(data: bytes) -> tuple[str, list[tuple[bytes, bytes]]] | None:
    """The byte order and the chunks of a WAV or AIFF file."""
    order = {b"RIFF": "<", b"FORM": ">"}.get(data[:4])
    if order is None or data[8:12] not in (b"WAVE", b"AIFF", b"AIFC"):
        return None
    out, at = [], 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    return order, out


#: Positions of pictures by the keys of an APE tag; others are front covers. Fixed values.
APE_KEYS = {"Cover Art (Front)": 3, "Cover Art (Back)": 4}


def _ape_items(data: bytes) -> tuple[int, int, list[tuple[int, str, bytes]]] | None:
    """Start and end of an APE tag, and its items (flags, key, value)."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    foot = data[end - 32 : end]
    if foot[:8] != b"APETAGEX":
        return None
    size, n, flags = struct.unpack_from("<III", foot, 12)
    start, items = end - size, []
    at = start
    for _ in range(n):
        length, mark = struct.unpack_from("<II", data, at)
        stop = data.index(b"\0", at + 8)
        items.append((mark, data[at + 8 : stop].decode("utf-8"), data[stop + 1 : stop + 1 + length]))
        at = stop + 1 + length
    return start - (32 if flags >> 31 else 0), end, items


def pages(data: bytes) -> Iterator[tuple[int, int, int, list[int], bytes]]:
    """(flags, position, stream, lacing values, body) of each Ogg page."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise Unsupported("not an Ogg page")
        flags, position, stream, _, _, n = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing = list(data[at + 27 : at + 27 + n])
        start = at + 27 + n
        yield flags, position, stream, lacing, data[start : start + sum(lacing)]
        at = start + sum(lacing)


def _ogg_crc() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_OGG = _ogg_crc()


def _page(flags: int, position: int, stream: int, number: int, lacing: list[int], body: bytes) -> bytes:
    head = b"OggS\0" + struct.pack("<BqIII", flags, position, stream, number, 0) + bytes((len(lacing),)) + bytes(lacing)
    raw, crc = head + body, 0
    for b in raw:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _OGG[crc >> 24 ^ b]
    return raw[:22] + struct.pack("<I", crc) + raw[26:]


def packets(data: bytes) -> tuple[int, list[tuple[bytes, int, bool]]]:
    """The stream's number and its packets, each with the position of its page if it is the last to end there (else -1), and whether a page ends
    with it. Files of several streams raise Unsupported."""
    out: list[tuple[bytes, int, bool]] = []
    held, streams = b"", set()
    for _, position, stream, lacing, body in pages(data):
        streams.add(stream)
        at, mine = 0, []
        for n in lacing:
            held += body[at : at + n]
            at += n
            if n < 255:
                mine.append(held)
                held = b""
        out += [(p, position if i == len(mine) - 1 else -1, i == len(mine) - 1) for i, p in enumerate(mine)]
    if len(streams) != 1 or held:
        raise Unsupported("Ogg with several streams, or cut short")
    return streams.pop(), out


def remuxed(data: bytes, keep_metadata: bool = True, change: Callable[[int, bytes], bytes] | None = None) -> bytes:
    """The same packets in as few pages as positions allow: header packets keep their page breaks, then pages of up to 255 segments end
    only after packets whose position is known."""
    stream, found = packets(data)
    headers = 2 if found and found[0][0].startswith(b"OpusHead") else 3
    out, number, lacing, body, position = [], 0, [], b"", 0

    def flush(flags: int, at: int) -> None:
        nonlocal number, lacing, body
        out.append(_page(flags, at, stream, number, lacing, body))
        number, lacing, body = number + 1, [], b""

    pending: list[bytes] = []
    for i, (packet, at, last) in enumerate(found):
        packet = change(i, packet) if change else packet
        pending.append(packet)
        if not last and i + 1 < len(found):
            continue
        more = [n for p in pending for n in [255] * (len(p) // 255) + [len(p) % 255]]
        if lacing and (len(lacing) + len(more) > 255 or i - len(pending) < headers):
            flush(0, position)
        lacing, body = lacing + more, body + b"".join(pending)
        pending, position = [], at
        while len(lacing) > 255:  # a packet longer than a page
            cut, rest = lacing[:255], lacing[255:]
            size = sum(cut)
            tail, body = body[size:], body[:size]
            lacing = cut
            flush(0, -1)
            lacing, body = rest, tail
    if lacing:
        flush(0, position)
    return _flagged(out)


def _flagged(made: list[bytes]) -> bytes:
    """Sets the marks of the first, the last and continued pages."""
    out, open_packet = [], False
    for i, page in enumerate(made):
        n = page[26]
        flags = (1 if open_packet else 0) | (2 if i == 0 else 0) | (4 if i == len(made) - 1 else 0)
        position, stream, number = struct.unpack_from("<qII", page, 6)
        lacing = list(page[27 : 27 + n])
        open_packet = bool(lacing) and lacing[-1] == 255
        out.append(_page(flags, position, stream, number, lacing, page[27 + n :]))
    return b"".join(out)


def ogg_canonical(data: bytes) -> bytes:
    """Packets, and the positions of those that pages end with."""
    _, found = packets(data)
    ends = [at for _, at, last in found if last]
    return b"".join(len(p).to_bytes(4, "big") + p for p, _, _ in found) + struct.pack("<q", ends[-1] if ends else 0)


def _comments(packet: bytes) -> tuple[bytes, bytes, list[bytes], bytes] | None:
    """Head, vendor, comments and what follows of a Vorbis or Opus comment packet."""
    head = next((h for h in (b"\x03vorbis", b"OpusTags") if packet.startswith(h)), None)
    if head is None:
        return None
    at = len(head)
    (n,) = struct.unpack_from("<I", packet, at)
    vendor, at = packet[at + 4 : at + 4 + n], at + 4 + n
    (count,) = struct.unpack_from("<I", packet, at)
    at, out = at + 4, []
    for _ in range(count):
        (n,) = struct.unpack_from("<I", packet, at)
        out.append(packet[at + 4 : at + 4 + n])
        at += 4 + n
    return head, vendor, out, packet[at:]


_BLOCK = b"METADATA_BLOCK_PICTURE="


def pictures(data: bytes) -> list[Picture]:
    """The pictures of a FLAC, MP3, WAV, AIFF, APE, MP4, Vorbis or Opus file, in order."""
    if data[:4] == b"fLaC":
        return flac_pictures(data)
    if data[:3] == b"ID3":
        return id3_pictures(data)
    if data[4:8] == b"ftyp":
        return mp4_covers(data)
    if data[:4] == b"OggS":
        found = next((c for p, _, _ in packets(data)[1][:3] if (c := _comments(p))), None)
        return [_picture_block(base64.b64decode(c[len(_BLOCK) :])) for c in found[2] if c.upper().startswith(_BLOCK)] if found else []
    if riff := _riff(data):
        return [p for name, body in riff[1] if name.lower() == b"id3 " for p in id3_pictures(body)]
    if tag := _ape_items(data):
        covers = [(key, *value.split(b"\0", 1)) for flags, key, value in tag[2] if flags & 6 == 2 and key.startswith("Cover Art") and b"\0" in value]
        return [(APE_KEYS.get(key, 3), image_type(body), name.decode("utf-8", "replace"), body) for key, name, body in covers]
    return []


def _flac(data: bytes, change: Change) -> bytes:
    from .flac import PICTURE, metadata

    blocks, at = metadata(data)
    out = []
    for i, (kind, body) in enumerate(blocks):
        if kind == PICTURE:
            old = _picture_block(body)[3]
            new = change(old)
            body = body[: len(body) - len(old) - 4] + struct.pack(">I", len(new)) + new
        out.append(bytes((kind | (128 if i == len(blocks) - 1 else 0),)) + len(body).to_bytes(3, "big") + body)
    return b"fLaC" + b"".join(out) + data[at:]


def _id3(data: bytes, change: Change) -> bytes:
    plain = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    spread = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    if data[3] not in (3, 4) or data[5] & 0xC0:
        raise Unsupported("ID3 variant")
    end, at, out = 10 + plain(data[6:10]), 10, []
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = plain(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 4] == b"APIC":
            old = id3_pictures(b"ID3" + data[3:6] + spread(10 + size) + data[at : at + 10 + size])[0][3]
            body = body[: len(body) - len(old)] + change(old)
        width = spread(len(body)) if data[3] == 4 else len(body).to_bytes(4, "big")
        out.append(data[at : at + 4] + width + data[at + 8 : at + 10] + body)
        at += 10 + size
    tag = b"".join(out)
    return data[:6] + spread(len(tag)) + tag + data[end:]


def _mp4(data: bytes, change: Change) -> bytes:
    inside = (b"moov", b"udta", b"meta", b"ilst", b"covr", b"trak", b"mdia", b"minf", b"stbl")

    def atoms(body: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(body):
            size = int.from_bytes(body[at : at + 4], "big") or len(body) - at
            if size < 8:
                raise Unsupported("MP4 atom of 64 bits")
            yield body[at + 4 : at + 8], body[at + 8 : at + size]
            at += size

    def rebuilt(name: bytes, body: bytes, shift: int, cover: bool) -> bytes:
        if name == b"data" and cover:
            body = body[:8] + change(body[8:])
        elif name in (b"stco", b"co64") and shift:
            code = ">I" if name == b"stco" else ">Q"
            body = body[:8] + b"".join(struct.pack(code, v[0] + shift) for v in struct.iter_unpack(code, body[8:]))
        elif name in inside:
            lead = 4 if name == b"meta" else 0
            body = body[:lead] + b"".join(rebuilt(n, b, shift, cover or name == b"covr") for n, b in atoms(body[lead:]))
        return struct.pack(">I", 8 + len(body)) + name + body

    top = list(atoms(data))
    names = [n for n, _ in top]
    new: list[bytes] = []
    keep = change

    def once(old: bytes) -> bytes:
        new.append(keep(old))
        return new[-1]

    change = once
    at = names.index(b"moov")
    moov = rebuilt(*top[at], 0, False)
    if b"mdat" in names[at:]:  # its samples move by what the covers saved
        shift, again = len(moov) - 8 - len(top[at][1]), iter(list(new))
        change = lambda old: next(again)
        moov = rebuilt(*top[at], shift, False)
    return b"".join(moov if i == at else struct.pack(">I", 8 + len(b)) + n + b for i, (n, b) in enumerate(top))


def _ape(data: bytes, change: Change) -> bytes:
    start, end, items = _ape_items(data)
    out = []
    for flags, key, value in items:
        if flags & 6 == 2 and key.startswith("Cover Art") and b"\0" in value:
            name, old = value.split(b"\0", 1)
            value = name + b"\0" + change(old)
        out.append(struct.pack("<II", len(value), flags) + key.encode() + b"\0" + value)
    body = b"".join(out)
    edge = lambda top: b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0x80000000 | (0x20000000 if top else 0)) + bytes(8)
    return data[:start] + edge(True) + body + edge(False) + data[end:]


def with_pictures(data: bytes, new: list[bytes]) -> bytes:
    """The file with its pictures replaced, in the order of ``pictures``; all else stays."""
    queue = iter(new)
    change: Change = lambda old: next(queue)
    if len(new) != len(pictures(data)):
        raise Unsupported("another number of pictures")
    if not new:
        return data
    if data[:4] == b"fLaC":
        return _flac(data, change)
    if data[:3] == b"ID3":
        return _id3(data, change)
    if data[4:8] == b"ftyp":
        return _mp4(data, change)
    if data[:4] == b"OggS":

        def other(i: int, packet: bytes) -> bytes:
            if i > 2 or (found := _comments(packet)) is None:
                return packet
            head, vendor, comments, rest = found
            for j, c in enumerate(comments):
                if c.upper().startswith(_BLOCK):
                    block = base64.b64decode(c[len(_BLOCK) :])
                    old = _picture_block(block)[3]
                    fresh = change(old)
                    comments[j] = c[: len(_BLOCK)] + base64.b64encode(block[: len(block) - len(old) - 4] + struct.pack(">I", len(fresh)) + fresh)
            return head + struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments) + rest

        return remuxed(data, change=other)
    if riff := _riff(data):
        order, chunks = riff
        body = data[8:12]
        for name, chunk in chunks:
            chunk = _id3(chunk, change) if name.lower() == b"id3 " else chunk
            body += name + struct.pack(order + "I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
        return data[:4] + struct.pack(order + "I", len(body)) + body
    return _ape(data, change)


def without_pictures(data: bytes) -> bytes:
    """What must be equal for two files to sound the same and be tagged alike, whatever bytes their pictures have."""
    n = len(pictures(data))
    return with_pictures(data, [b""] * n) if n else data
