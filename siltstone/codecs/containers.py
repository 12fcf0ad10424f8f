"""Containers: members out of bytes, and bytes out of members, by format."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images, iso

ZIP_LIKE = frozenset("zip docx xlsx pptx ods odt odp odg odf epub cbz jar xpi ora dwfx xps apk".split())
TAR_LIKE = frozenset(("tar", "cbt"))
SINGLE = frozenset(("gz", "bz2", "xz", "zst"))
#: The member that must come first in a format's container.
FIRST = {"epub": "mimetype", "odt": "mimetype", "ods": "mimetype", "odp": "mimetype", "odg": "mimetype", "docx": "[Content_Types].xml", "xlsx": "[Content_Types].xml", "pptx": "[Content_Types].xml"}
STORED = frozenset(("epub", "odt", "ods", "odp", "odg"))
NATURAL = frozenset(("cbz", "cbt"))
MEMBERS = "parent_id string, seq int, rel_path string, kind string, content binary, link string, error string"
MAX_BYTES = 1 << 31
#: Sound files, as containers of their pictures; extensions of those. Fixed values.
AUDIO = "audio"
PICTURE_EXT = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp"}

Member = tuple[str, str, bytes | None, str | None]  # path, kind, content, link target


class Unreadable(ValueError):
    pass


def safe_path(path: str) -> str | None:
    """The path normalised, component by component; None if it is empty, holds a NUL or leads outside."""
    if not path or "\0" in path:
        return None
    out: list[str] = []
    for part in path.replace("\\", "/").lstrip("/").split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) or None


def natural_sort_key(path: str):
    import re

    return [(1, len(t), t) if t[0].isdigit() else (0 if t < "0" else 2, 0, t) for t in (x.lstrip("0") or "0" if x[0].isdigit() else x for x in re.findall("[0-9]+|[^0-9]", path))], len(path), path


def read_members(data: bytes, fmt: str, max_bytes: int = MAX_BYTES) -> list[Member]:
    """The members of a container in their order; unsafe paths are left out. Raises Unreadable for bytes that aren't such a container,
    or that unpack to more than ``max_bytes``."""
    try:
        if fmt in ZIP_LIKE:
            return _zip_members(data, max_bytes)
        if fmt in TAR_LIKE:
            return _tar_members(data)
        if fmt in SINGLE:
            raw = _inflated(data, fmt, max_bytes)
            try:
                return _tar_members(raw)
            except tarfile.TarError:
                return [("data", "file", raw, None)]
        if fmt == "a":
            return _ar_members(data)
        if fmt == "cpio":
            return _cpio_members(data)
        if fmt == "iso":
            return [(path, kind, content, None) for name, kind, content in iso.members(data) if (path := safe_path(name))]
        if fmt == AUDIO:
            from . import audio

            return [(f"cover_{i}{PICTURE_EXT.get(mime, '.jpg')}", "file", body, None) for i, (_, mime, _, body) in enumerate(audio.pictures(data))]
    except Unreadable:
        raise
    except Exception as e:
        raise Unreadable(f"{fmt}: {e}") from e
    raise Unreadable(f"no reader for {fmt}")


def _inflated(data: bytes, fmt: str, max_bytes: int) -> bytes:
    stream = {"gz": lambda b: gzip.GzipFile(fileobj=b), "bz2": bz2.BZ2File, "xz": lzma.LZMAFile, "zst": lambda b: zstandard.ZstdDecompressor().stream_reader(b, read_across_frames=True)}[fmt](io.BytesIO(data))
    raw = stream.read(max_bytes + 1)
    if len(raw) > max_bytes:
        raise Unreadable("unpacks to too many bytes")
    return raw


def _zip_members(data: bytes, max_bytes: int) -> list[Member]:
    out: list[Member] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > max_bytes:
            raise Unreadable("unpacks to too many bytes")
        for info in z.infolist():
            if path := safe_path(info.filename):
                out.append((path, "dir", None, None) if info.is_dir() else (path, "file", z.read(info), None))
    return out


def _tar_members(data: bytes) -> list[Member]:
    out: list[Member] = []
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for m in t:
            if not (path := safe_path(m.name)):
                continue
            if m.isdir():
                out.append((path, "dir", None, None))
            elif m.issym() or m.islnk():
                out.append((path, "symlink" if m.issym() else "hardlink", None, m.linkname))
            elif m.isfile():
                out.append((path, "file", t.extractfile(m).read(), None))
    return out


def _ar_members(data: bytes) -> list[Member]:
    if not data.startswith(b"!<arch>\n"):
        raise Unreadable("not an ar archive")
    out, at = [], 8
    while at + 60 <= len(data):
        name, size = data[at : at + 16].decode("latin-1").rstrip(), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        if name.startswith("#1/"):
            n = int(name[3:])
            name, body = body[:n].rstrip(b"\0").decode(), body[n:]
        if path := safe_path(name.rstrip("/")):
            out.append((path, "file", body, None))
        at += 60 + size + (size & 1)
    return out


def _cpio_members(data: bytes) -> list[Member]:
    """The newc layout."""
    out, at = [], 0
    while data[at : at + 6] == b"070701":
        field = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
        mode, size, named = field[1], field[6], field[11]
        name = data[at + 110 : at + 110 + named - 1].decode()
        start = (at + 110 + named + 3) & ~3
        if name == "TRAILER!!!":
            return out
        if path := safe_path(name):
            out.append((path, "dir", None, None) if mode & 0o170000 == 0o040000 else (path, "file", data[start : start + size], None))
        at = (start + size + 3) & ~3
    raise Unreadable("not a cpio archive")


def ordered(members: list[Member], fmt: str) -> list[Member]:
    """Comics in natural order, and the format's special member first."""
    if fmt in NATURAL:
        members = sorted(members, key=lambda m: natural_sort_key(m[0]))
    return sorted(members, key=lambda m: m[0] != FIRST.get(fmt))


def write_members(members: list[Member], fmt: str) -> bytes:
    """A container of the format, deterministic: no times, fixed permissions."""
    members = ordered(members, fmt)
    if fmt in ZIP_LIKE:
        return _zip(members, stored=fmt in STORED)
    if fmt in TAR_LIKE:
        return _tar(members)
    if fmt in SINGLE:
        raw = members[0][2] if len(members) == 1 and members[0][0] == "data" else _tar(members)
        return {"gz": lambda b: gzip.compress(b, 9, mtime=0), "bz2": lambda b: bz2.compress(b, 9), "xz": xz, "zst": lambda b: zstandard.ZstdCompressor(level=22).compress(b)}[fmt](raw)
    if fmt == "a":
        return _ar(members)
    if fmt == "cpio":
        return _cpio(members)
    if fmt == "iso":
        return iso.write([m[:3] for m in members])
    raise Unreadable(f"no writer for {fmt}")


def xz(data: bytes, preset: int = 9) -> bytes:
    """The preset with a dictionary no longer than the data: the encoder's tables grow with it, to 674 MB cleared for each stream."""
    size = min(64 << 20 if preset == 9 else 8 << 20, max(4096, 1 << (len(data) - 1).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": size}])


def _zip(members: list[Member], stored: bool) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path, kind, content, _ in members:
            info = zipfile.ZipInfo(path + ("/" if kind == "dir" else ""), (1980, 1, 1, 0, 0, 0))
            info.external_attr = (0o40755 if kind == "dir" else 0o100644) << 16
            info.create_system = 3
            info.compress_type = zipfile.ZIP_STORED if stored or kind == "dir" else zipfile.ZIP_DEFLATED
            z.writestr(info, content or b"", compresslevel=9)
    return buffer.getvalue()


def _tar(members: list[Member]) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=tarfile.PAX_FORMAT) as t:
        for path, kind, content, link in members:
            info = tarfile.TarInfo(path)
            info.type = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}.get(kind, tarfile.REGTYPE)
            info.mode, info.linkname, info.size = 0o755 if kind == "dir" else 0o644, link or "", len(content or b"")
            t.addfile(info, io.BytesIO(content or b""))
    return buffer.getvalue()


def _ar(members: list[Member]) -> bytes:
    out = [b"!<arch>\n"]
    for path, _, content, _ in members:
        name, body = path.encode(), content or b""
        head = b"#1/%d" % len(name)
        size = len(name) + len(body)
        out += b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (head, 0, 0, 0, b"100644", size), name, body, b"\n" * (size & 1)
    return b"".join(out)


def _cpio(members: list[Member]) -> bytes:
    out = b""
    for i, (path, kind, content, _) in enumerate([*members, ("TRAILER!!!", "file", b"", None)]):
        name, body = path.encode() + b"\0", content or b""
        field = [i + 1, 0o40755 if kind == "dir" else 0o100644, 0, 0, 1, 0, len(body), 0, 0, 0, 0, len(name), 0]
        out += b"070701" + b"".join(b"%08X" % f for f in field) + name
        out += b"\0" * (-len(out) % 4) + body
        out += b"\0" * (-len(out) % 4)
    return out


def unpack(containers: DataFrame, *kept: str) -> DataFrame:
    """From parent_id, format, content: one row per member, with the columns that are to be kept; a container that can't be read gives
    one row with its error. A worker holds a hundred containers at most (spark.sql.execution.python.udf.maxRecordsPerBatch)."""

    def run(fmt: str, data: bytes) -> list[tuple]:
        try:
            return [(i, *m, None) for i, m in enumerate(read_members(bytes(data), fmt))]
        except Unreadable as e:
            return [(None, None, None, None, None, str(e))]

    parent, _, rest = MEMBERS.partition(", ")
    opened = F.udf(run, f"array<struct<{rest}>>", useArrow=False).asNondeterministic()
    rows = containers.select(F.col("parent_id").cast(parent.split()[1]), *kept, opened("format", "content").alias("_members"))
    return rows.select("parent_id", *kept, F.inline("_members"))


def pack(members: DataFrame) -> DataFrame:
    """From parent_id, format, seq, rel_path, content (and kind, link): parent_id, format, content. A container is built by one task,
    as it is one file."""
    have = set(members.columns)
    kind, link = F.col("kind") if "kind" in have else F.lit("file"), F.col("link") if "link" in have else F.lit(None).cast("string")

    def run(fmt: str, rows: list) -> bytes:
        rows = sorted(rows, key=lambda r: (r["seq"] is None, r["seq"]))
        return write_members([(r["rel_path"], r["kind"], None if r["content"] is None else bytes(r["content"]), r["link"]) for r in rows], fmt)

    groups = members.groupBy("parent_id", "format").agg(F.collect_list(F.struct("seq", "rel_path", kind.alias("kind"), "content", link.alias("link"))).alias("m"))
    return groups.select("parent_id", "format", F.udf(run, "binary", useArrow=False).asNondeterministic()("format", "m").alias("content"))


def pdf_streams(data: bytes) -> dict[int, tuple[dict[str, str], bytes, bool]]:
    """Object id → (dictionary's names, decoded bytes, whether they could be decoded) of a PDF's plain stream objects."""
    import re

    out = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\s*<<((?:(?!endobj).)*?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        if end < 0:
            continue
        length = re.search(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)", m[2])
        body = data[m.end() : m.end() + int(length[1])] if length else data[m.end() : end].rstrip(b"\r\n")
        names = {k.decode(): v.decode() for k, v in re.findall(rb"(/[A-Za-z0-9]+)\s*\[?\s*(/[A-Za-z0-9]+)", m[2])}
        if names.get("/Filter") == "/FlateDecode":
            try:
                out[int(m[1])] = names, _unpredicted(zlib.decompress(body), m[2]), True
                continue
            except (zlib.error, ValueError):
                pass
        out[int(m[1])] = names, body, "/Filter" not in names
    return out


def _unpredicted(raw: bytes, head: bytes) -> bytes:
    """A stream's bytes after the prediction its head names. Raises ValueError for predictors that aren't those of PNG."""
    import re

    how = {name: int(value) for name, value in re.findall(rb"/(Predictor|Columns|Colors|BitsPerComponent)\s+(\d+)", head[head.find(b"/DecodeParms") :])} if b"/DecodeParms" in head else {}
    if how.get(b"Predictor", 1) == 1:
        return raw
    if how[b"Predictor"] < 10:
        raise ValueError("predictor")
    bits = how.get(b"Colors", 1) * how.get(b"BitsPerComponent", 8)
    stride = (bits * how.get(b"Columns", 1) + 7) // 8
    return images._unfilter(raw, len(raw) // (stride + 1), stride, max(1, bits // 8)).tobytes()


def flac_pictures(data: bytes) -> list[tuple[int, str, str, bytes]]:
    """(picture type, content type, description, bytes) of a FLAC file's picture blocks."""
    if data[:4] != b"fLaC":
        return []
    out, at, last = [], 4, False
    while not last and at + 4 <= len(data):
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        last, block = bool(head & 0x80), data[at + 4 : at + 4 + size]
        if head & 0x7F == 6:
            out.append(_picture_block(block))
        at += 4 + size
    return out


def _picture_block(block: bytes) -> tuple[int, str, str, bytes]:
    kind, n = struct.unpack_from(">II", block)
    mime, at = block[8 : 8 + n].decode("ascii", "replace"), 8 + n
    (d,) = struct.unpack_from(">I", block, at)
    text, at = block[at + 4 : at + 4 + d].decode("utf-8", "replace"), at + 4 + d + 16
    (size,) = struct.unpack_from(">I", block, at)
    return kind, mime, text, block[at + 4 : at + 4 + size]


def id3_pictures(data: bytes) -> list[tuple[int, str, str, bytes]]:
    """The same for the attached pictures of an ID3v2.3 or 2.4 tag."""
    if data[:3] != b"ID3" or data[3] not in (3, 4):
        return []
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    out, at, end = [], 10, 10 + safe(data[6:10])
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = safe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 4] == b"APIC":
            wide = body[0] in (1, 2)
            stop = body.index(b"\0", 1)
            mime, kind, rest = body[1:stop].decode("latin-1"), body[stop + 1], body[stop + 2 :]
            cut = next(i for i in range(0, len(rest), 2) if rest[i : i + 2] == b"\0\0") if wide else rest.index(b"\0")
            out.append((kind, mime, rest[:cut].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}[body[0]], "replace"), rest[cut + (2 if wide else 1) :]))
        at += 10 + size
    return out


def mp4_covers(data: bytes) -> list[tuple[int, str, str, bytes]]:
    """The same for the covr atoms of an MP4 file's item list."""
    out = []

    def walk(start: int, end: int) -> None:
        at = start
        while at + 8 <= end:
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if size < 8:
                return
            if name == b"data" and in_cover:
                kind = int.from_bytes(data[at + 8 : at + 12], "big")
                out.append((3, {13: "image/jpeg", 14: "image/png", 27: "image/bmp"}.get(kind, ""), "", data[at + 16 : at + size]))
            elif name in (b"moov", b"udta", b"ilst", b"covr"):
                in_cover.append(1) if name == b"covr" else None
                walk(at + 8, at + size)
                in_cover.pop() if name == b"covr" else None
            elif name == b"meta":
                walk(at + 12, at + size)
            at += size

    in_cover: list[int] = []
    walk(0, len(data))
    return out
