"""Scalar functions over columns: paths, text, report values, ordering keys, bytes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none. A leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def is_junk(path: Column) -> Column:
    """Resource forks and folder settings of desktops."""
    name = basename(path)
    return name.startswith("._") | F.lower(name).isin(".ds_store", "desktop.ini")


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(or_, [path.rlike(p) for p in patterns], F.lit(False))


def magic_mime(content: Column) -> Column:
    """The content type by magic number, in order of priority; null if none fits."""
    out = None
    for offset, digits, mime in dims.MAGIC:
        fits = F.substring(content, F.lit(offset + 1), F.lit(len(digits) // 2)) == F.lit(bytes.fromhex(digits))
        if (offset, mime) in dims.MAGIC_DIGITS:  # a sequence number goes before
            fits &= F.hex(F.substring(content, F.lit(1), F.lit(offset))).rlike(f"^(3[0-9]|20|00){{{offset}}}$")
        out = F.when(fits, mime) if out is None else out.when(fits, mime)
    return out


def mime_by_extension(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.EXT_MIMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(dims.DEFAULT_MIME))


def is_mp3_layer3(content: Column) -> Column:
    """Frame sync with layer III bits in the first two bytes."""
    head = F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int")
    return F.coalesce((head.bitwiseAND(0xFFE0) == 0xFFE0) & (head.bitwiseAND(0x0006) == 0x0002), F.lit(False))


def is_vorbis(content: Column) -> Column:
    """An Ogg page whose first packet is a Vorbis identification header."""
    segments = F.conv(F.hex(F.substring(content, 27, 1)), 16, 10).cast("int")
    head = F.substring(content, F.lit(28) + segments, F.lit(7))
    return F.coalesce((F.substring(content, 1, 4) == F.lit(b"OggS")) & (head == F.lit(b"\x01vorbis")), F.lit(False))


def format_name(alias: Column) -> Column:
    """The printed name of a format or alias, whatever its case; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in dims.FORMAT_ALIASES.items() for x in pair])
    return F.try_element_at(table, F.lower(alias))


def container_format(mime: Column, path: Column) -> Column:
    """By content type, then by extension, then by compound suffix; else unknown."""
    by_mime = F.try_element_at(F.create_map(*[F.lit(x) for pair in dims.MIME_FORMATS.items() for x in pair]), mime)
    ext = F.regexp_replace(extension(path), r"^\.", "")
    low = F.lower(path)
    compound = F.when(low.rlike(r"\.tar\.(gz|bz2|xz)$"), "tar").when(low.rlike(r"\.(tar\.zst|tzst)$"), "zst")
    return F.coalesce(by_mime, format_name(ext), compound, F.lit("unknown"))


def can_write(fmt: Column) -> Column:
    return ~fmt.isin(*dims.READ_ONLY, "unknown")


def safe_member_path(path: Column) -> Column:
    """A member's path inside its container, normalised; null if it is empty, holds a NUL or leads outside."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    # depth after each part; a path leads outside if it ever falls below zero
    steps = F.transform(parts, lambda p: F.when(p == "..", -1).otherwise(1))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a["d"] + s).alias("d"), F.least(a["low"], a["d"] + s).alias("low")))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    good = (F.length(F.coalesce(path, F.lit(""))) > 0) & (F.instr(path, "\0") == 0) & (walk["low"] >= 0) & (F.size(kept) > 0)
    return F.when(good, F.array_join(kept, "/"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def csv_escape(text: Column) -> Column:
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 3), F.lit("...")))


def delta_percent(before: Column, after: Column, success: Column) -> Column:
    """Saved share in percent; negative if it grew; 0 for failures and empty files."""
    return F.when(success & (before > 0), 100.0 * (1.0 - after / F.nullif(before, F.lit(0)))).otherwise(0.0)


def kilobytes(size: Column) -> Column:
    """Whole kilobytes, towards zero."""
    return ((size - size % 1024) / 1024).cast("bigint")


def outcome(success: Column, replaced: Column) -> Column:
    return F.when(~success, "FAIL").when(replaced, "OK (replaced)").otherwise("OK (skipped)")


def codec_trail(codecs: Column, mode: str) -> Column:
    """``name:pct%`` for each codec, by arrows for a pipe, by semicolons for candidates side by side."""
    parts = F.transform(codecs, lambda c: F.format_string("%s:%.2f%%", c["name"], c["pct"]))
    return F.array_join(parts, " -> " if mode == "pipe" else "; ")


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Whole seconds left at the rate so far; null before the first is done."""
    return F.when((done > 0) & (total > 0) & (elapsed > 0), F.floor((total - done) / (done / elapsed)))


def eta_text(done: Column, total: Column, elapsed: Column) -> Column:
    s = eta_seconds(done, total, elapsed).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60))
    return F.when(s.isNull(), "--:--").otherwise(F.concat(F.when(h > 0, F.format_string("%dh ", h)).otherwise(""), F.format_string("%02dm %02ds", m, r)))


def progress_percent(done: Column, total: Column) -> Column:
    p = 100.0 * done / F.nullif(total, F.lit(0))
    return F.when(total > 0, F.when((done < total) & (p >= 99.95), 99.9).when(done == total, 100.0).otherwise(p)).otherwise(0.0)


def natural_key(path: Column) -> Column:
    """A key whose order is the natural one: runs of digits by value, all else bytewise."""
    tokens = F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9])"), F.lit(1))

    def part(t: Column) -> Column:
        bare = F.regexp_replace(t, "^0+(?=[0-9])", "")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(t)

    return F.struct(F.array_join(F.transform(tokens, part), "").alias("key"), F.length(path).alias("length"), path.alias("path"))


def record_length(version: Column, sample_type: Column, samples: Column) -> Column:
    """Bytes of a seismic record: 131072 for version 3; version 2 always keeps to 256."""
    return F.when(version == 3, 131072).otherwise(256)


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    long = lambda c: c.cast("bigint")
    return F.shiftleft(long(r), 24).bitwiseOR(F.shiftleft(long(g), 16)).bitwiseOR(F.shiftleft(long(b), 8)).bitwiseOR(long(a))


def ceil_log2(x: Column) -> Column:
    return F.ceil(F.log2(x))


def beyond_tolerance(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) > F.abs(a) * tolerance


def picture_extension(mime: Column) -> Column:
    """The extension of an embedded picture; those of untold type count as JPEG."""
    return F.when(mime == "image/png", ".png").when(mime == "image/webp", ".webp").otherwise(".jpg")


def cover_key(kind: Column) -> Column:
    """The key of an APE tag for a picture's position."""
    return F.when(kind == 4, "Cover Art (Back)").otherwise("Cover Art (Front)")


def cover_position(key: Column) -> Column:
    return F.when(key == "Cover Art (Back)", 4).otherwise(3)


def cover_format(mime: Column) -> Column:
    """The type number of an MP4 cover: 14 for PNG, else 13 for JPEG."""
    return F.when(mime == "image/png", 14).otherwise(13)


def _whole(content: Column, at: Column, n: int) -> Column:
    """``n`` bytes from position ``at`` (from 1) on as a number, the highest first."""
    return F.conv(F.hex(F.substring(content, at, F.lit(n))), 16, 10).cast("bigint")


def jpeg_size(content: Column) -> Column:
    """struct<width, height, depth, colors> from a JPEG's frame header; null for other content. Segments are walked through; the frame header is
    among the first 64 of them."""
    start = F.struct(F.lit(3).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("frame"))

    def step(state: Column, _: Column) -> Column:
        marker = _whole(content, state["at"].cast("int") + 1, 1)
        here = (marker >= 0xC0) & (marker <= 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        found = F.coalesce(state["frame"], F.when(here, state["at"]))
        return F.struct(F.when(found.isNull(), state["at"] + 2 + _whole(content, state["at"].cast("int") + 2, 2)).otherwise(state["at"]).alias("at"), found.alias("frame"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["frame"].cast("int")
    head = F.struct(_whole(content, at + 7, 2).alias("width"), _whole(content, at + 5, 2).alias("height"), _whole(content, at + 4, 1).alias("depth"), _whole(content, at + 9, 1).alias("colors"))
    return F.when((F.substring(content, 1, 2) == F.lit(b"\xff\xd8")) & at.isNotNull(), head)


def webp_size(content: Column) -> Column:
    """struct<width, height> from a WebP's first chunk (lossy, lossless or extended); null for other content."""
    little = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(content, F.lit(at + i), F.lit(1))) for i in range(n - 1, -1, -1)]), 16, 10).cast("bigint")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind = F.substring(content, 13, 4)
    packed = little(22, 4)
    mask = F.lit(0x3FFF).cast("bigint")
    head = (
        F.when(kind == F.lit(b"VP8X"), size(little(25, 3) + 1, little(28, 3) + 1))
        .when(kind == F.lit(b"VP8L"), size(packed.bitwiseAND(mask) + 1, F.shiftright(packed, 14).bitwiseAND(mask) + 1))
        .when(kind == F.lit(b"VP8 "), size(little(27, 2).bitwiseAND(mask), little(29, 2).bitwiseAND(mask)))
    )
    return F.when((F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP")), head)


def png_size(content: Column) -> Column:
    """struct<width, height, depth, color_type> from a PNG's header; null for other content."""
    whole = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("bigint")
    head = F.struct(whole(17, 4).alias("width"), whole(21, 4).alias("height"), whole(25, 1).alias("depth"), whole(26, 1).alias("color_type"))
    return F.when(F.substring(content, 1, 8) == F.lit(bytes.fromhex("89504E470D0A1A0A")), head)


def flac_md5(content: Column) -> Column:
    """The digest of the samples in a FLAC file's stream information, in lower-case hex; null for other content."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"fLaC"), F.lower(F.hex(F.substring(content, 27, 16))))


def pdf_stream_ext(subtype: Column, filters: Column, keys: Column, kind: Column, data: Column) -> Column:
    """The extension of a PDF stream from its dictionary (subtype, single filter name, keys, type), else by its first bytes."""
    starts = lambda digits: F.substring(data, F.lit(1), F.lit(len(digits) // 2)) == F.lit(bytes.fromhex(digits))
    image = F.coalesce(subtype == "/Image", F.lit(False))
    return (
        F.when(image & (filters == "/DCTDecode"), ".jpg")
        .when(image & (filters == "/JPXDecode"), ".jp2")
        .when(image & (filters == "/FlateDecode"), F.when(starts("89504E47"), ".png").otherwise(".raw"))
        .when(subtype == "/Form", ".form")
        .when(F.array_contains(keys, "/FontFile2"), ".ttf")
        .when(F.array_contains(keys, "/FontFile3"), F.when(subtype == "/Type1C", ".otf").otherwise(".cff"))
        .when(kind == "/Metadata", ".xml")
        .when(starts("FFD8"), ".jpg").when(starts("89504E47"), ".png").when(starts("25504446"), ".pdf").when(starts("4F54544F"), ".otf")
        .otherwise(".bin")
    )
