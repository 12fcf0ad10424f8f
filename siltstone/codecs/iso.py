"""ISO 9660 images: files of the primary directory tree, and images of one level of interchange with plain names."""

from __future__ import annotations

import struct

from .images import Unsupported

SECTOR = 2048


def _entries(data: bytes, start: int, size: int):
    at, end = start, start + size
    while at < end:
        n = data[at]
        if not n:  # records don't cross sectors
            at = (at // SECTOR + 1) * SECTOR
            continue
        place, length, flags, named = struct.unpack_from("<I", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0], data[at + 25], data[at + 32]
        name = data[at + 33 : at + 33 + named]
        if name not in (b"\0", b"\1"):
            yield name, place * SECTOR, length, bool(flags & 2), _rock_ridge(data[at + 33 + named + (named + 1) % 2 : at + n])
        at += n


def _rock_ridge(area: bytes) -> str | None:
    """The alternate name in a record's system area."""
    at, out = 0, b""
    while at + 4 <= len(area) and area[at + 2] >= 4:
        if area[at : at + 2] == b"NM":
            out += area[at + 5 : at + area[at + 2]]
        at += area[at + 2]
    return out.decode("utf-8", "replace") or None


def members(data: bytes) -> list[tuple[str, str, bytes | None]]:
    """(path, kind, content) in the order of the directories."""
    if data[16 * SECTOR + 1 : 16 * SECTOR + 6] != b"CD001" or data[16 * SECTOR] != 1:
        raise Unsupported("not an ISO image")
    root = 16 * SECTOR + 156
    out, seen = [], set()

    def walk(start: int, size: int, above: str) -> None:
        if start in seen or start + size > len(data):
            raise Unsupported("bad ISO directory")
        seen.add(start)
        for name, place, length, folder, other in _entries(data, start, size):
            path = above + (other or name.decode("latin-1").split(";")[0].removesuffix("."))
            if folder:
                out.append((path, "dir", None))
                walk(place, length, path + "/")
            elif place + length > len(data):
                raise Unsupported("truncated ISO image")
            else:
                out.append((path, "file", data[place : place + length]))

    walk(struct.unpack_from("<I", data, root + 2)[0] * SECTOR, struct.unpack_from("<I", data, root + 10)[0], "")
    return out


def _both(n: int) -> bytes:
    return struct.pack("<I", n) + struct.pack(">I", n)


def _record(name: bytes, place: int, size: int, folder: bool, other: bytes = b"") -> bytes:
    alternate = b"".join(b"NM" + bytes((5 + len(p), 1, 1 if i + 100 < len(other) else 0)) + p for i in range(0, len(other), 100) for p in (other[i : i + 100],))
    body = _both(place) + _both(size) + bytes(7) + bytes((2 if folder else 0, 0, 0)) + struct.pack("<H", 1) + struct.pack(">H", 1) + bytes((len(name),)) + name + b"\0" * ((len(name) + 1) % 2)
    n = 2 + len(body) + len(alternate)
    return bytes((n + n % 2, 0)) + body + alternate + b"\0" * (n % 2)


def write(files: list[tuple[str, str, bytes | None]]) -> bytes:
    """An image of the files, in their order; names go into the alternate name field. Without times. Other kinds than files and folders raise
    Unsupported."""
    if any(kind not in ("file", "dir") for _, kind, _ in files):
        raise Unsupported("links in an ISO image")
    folders: dict[str, list[tuple[str, bytes | None]]] = {"": []}

    def folder(path: str) -> None:
        if path not in folders:
            above, _, name = path.rpartition("/")
            folder(above)
            folders[path] = []
            folders[above].append((name, None))

    for path, kind, content in files:
        if kind == "dir":
            folder(path)
        else:
            above, _, name = path.rpartition("/")
            folder(above)
            folders[above].append((name, content or b""))
    if any(len(name.encode()) > 180 for rows in folders.values() for name, _ in rows):
        raise Unsupported("long name in an ISO image")

    def listing(path: str, place: dict[str, int], size: dict[str, int], at: dict[tuple[str, int], int]) -> bytes:
        above = path.rpartition("/")[0]
        out = b""
        rows = [_record(b"\0", place[path], size[path], True), _record(b"\1", place[above], size[above], True)]
        for i, (name, content) in enumerate(folders[path]):
            inner = f"{path}/{name}".lstrip("/")
            rows.append(_record(b"D%07d" % i, place[inner], size[inner], True, name.encode()) if content is None else _record(b"F%07d.;1" % i, at[path, i], len(content), False, name.encode()))
        for r in rows:
            if len(out) % SECTOR + len(r) > SECTOR:
                out += b"\0" * (-len(out) % SECTOR)
            out += r
        return out + b"\0" * (-len(out) % SECTOR)

    zero = {p: 0 for p in folders}
    none = {(p, i): 0 for p, rows in folders.items() for i in range(len(rows))}
    size = {p: len(listing(p, zero, zero, none)) for p in folders}
    place, at, next_sector = {}, {}, 19
    for p in folders:
        place[p], next_sector = next_sector, next_sector + size[p] // SECTOR
    for p, rows in folders.items():
        for i, (_, content) in enumerate(rows):
            if content is not None:
                at[p, i], next_sector = next_sector, next_sector + -(-len(content) // SECTOR)
    head = b"\1CD001\1\0" + b" " * 64 + bytes(8) + _both(next_sector) + bytes(32) + (struct.pack("<H", 1) + struct.pack(">H", 1)) * 2 + struct.pack("<H", SECTOR) + struct.pack(">H", SECTOR)
    head += _both(10) + struct.pack("<I", 18) + bytes(4) + struct.pack(">I", 18) + bytes(4) + _record(b"\0", place[""], size[""], True) + b" " * 623 + (b"0" * 16 + b"\0") * 4 + b"\1\0"
    table = b"\1\0" + struct.pack("<I", place[""]) + b"\1\0\0\0"
    out = [bytes(16 * SECTOR), head.ljust(SECTOR, b"\0"), b"\xffCD001\1".ljust(SECTOR, b"\0"), table.ljust(SECTOR, b"\0")]
    out += [listing(p, place, size, at) for p in folders]
    out += [content + b"\0" * (-len(content) % SECTOR) for rows in folders.values() for _, content in rows if content is not None]
    return b"".join(out)
