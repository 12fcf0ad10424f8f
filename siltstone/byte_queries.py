"""Queries over real bytes: rows of the tables are written into files of each kind, and what readers, encoders, sinks and the engine make of them is
held against SQL over the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codecs import audio, containers, pdf, registry, samples
from .engine import Engine
from .functions import scalar
from .functions import sql as sql_functions
from .operators import lookup, order, select
from .plans import dims
from .queries import ORACLE_SQL, QUERIES, _doc_path, _page_files, _PAGE_EXT, _PAGE_FILES, _PROC_EXTS, _results, _RESULTS_SQL, _t, query
from .session import shared_folder
from .settings import Settings
from .sinks import csv_report, files
from .sources import media, scan
from .streaming.sessions import arriving_files


def _map(make: Callable, returns: str) -> Callable[..., Column]:
    """A function of one row's values as a column function. Rows go to a worker by the hundred, not by the ten thousand as with Arrow:
    each may be a file."""

    def run(*row):
        return make(*(bytes(v) if isinstance(v, (bytearray, memoryview)) else v for v in row))

    return lambda *columns: F.udf(run, returns, useArrow=False).asNondeterministic()(*columns)


_md5 = lambda c: F.md5(F.col(c))

# Containers

_KINDS = ("zip", "tar", "a", "cpio", "iso", "cbz", "cbt", "jar")
_MEMBERS_SQL = "m as (select conv_id, turn, text, (row_number() over (partition by conv_id order by turn) - 1)::int as seq, count(*) over (partition by conv_id) as n from conversations)"


def _members(spark, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("parent_id"), F.col("turn").cast("int").alias("seq"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").cast("binary").alias("content"), F.col("conv_id"))


def _pick(names: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int"))


def _pick_sql(names: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(x) for x in names)}][{n} % {len(names)} + 1]"


@query(f"with {_MEMBERS_SQL} select conv_id::varchar as parent_id, {_pick_sql(_KINDS, 'conv_id')} as format, seq, 'turn' || turn || '.txt' as rel_path, md5(text) as digest from m")
def q49_archive_members(spark, sf_dir):
    packed = containers.pack(_members(spark, sf_dir).withColumn("format", _pick(_KINDS, F.col("conv_id"))))
    return containers.unpack(packed, "format").select("parent_id", "format", "seq", "rel_path", _md5("content").alias("digest"))


_STREAMS = ("gz", "bz2", "xz", "zst")


@query(f"select page_id::varchar as parent_id, {_pick_sql(_STREAMS, 'page_id')} as format, 'data' as rel_path, 'file' as kind, md5(html) as digest from pages")
def q50_packed_streams(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("parent_id"), _pick(_STREAMS, F.col("page_id")).alias("format"), F.lit(0).alias("seq"), F.lit("data").alias("rel_path"), F.col("html").cast("binary").alias("content"))
    return containers.unpack(containers.pack(p), "format").select("parent_id", "format", "rel_path", "kind", _md5("content").alias("digest"))


def _office(spark, sf_dir: str, formats: tuple[str, ...], first: Column, content: Column) -> DataFrame:
    """Members in order, with the one that must come first put last."""
    rows = _members(spark, sf_dir).withColumn("format", _pick(formats, F.col("conv_id")))
    special = rows.select("parent_id", "format").distinct().select("parent_id", F.lit(1 << 30).alias("seq"), first.alias("rel_path"), content.cast("binary").alias("content"), "format")
    return containers.pack(rows.select(special.columns).unionByName(special))


_OOXML = ("docx", "xlsx", "pptx")


@query(f"with {_MEMBERS_SQL} select conv_id::varchar as parent_id, {_pick_sql(_OOXML, 'conv_id')} as format, '[Content_Types].xml' as first_path, count(*) + 1 as members from m group by conv_id")
def q51_ooxml_rebuild(spark, sf_dir):
    packed = _office(spark, sf_dir, _OOXML, F.lit("[Content_Types].xml"), F.lit("<Types/>"))
    return containers.unpack(packed, "format").groupBy("parent_id", "format").agg(F.min_by("rel_path", "seq").alias("first_path"), F.count("*").alias("members"))


_ODF = {"odt": "application/vnd.oasis.opendocument.text", "epub": "application/epub+zip"}


@query(f"with {_MEMBERS_SQL} select conv_id::varchar as parent_id, case conv_id % 2 when 0 then '{_ODF['odt']}' else '{_ODF['epub']}' end as mime, true as is_stored, count(*) + 1 as members from m group by conv_id")
def q52_odf_rebuild(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for p in _ODF.items() for x in p])
    packed = _office(spark, sf_dir, tuple(_ODF), F.lit("mimetype"), F.element_at(kind, F.col("format")))
    # told by the first bytes, which only works if mimetype comes first and is stored
    told = packed.select("parent_id", "format", "content", scalar.magic_mime(F.col("content")).alias("mime"), (F.hex(F.substring("content", 9, 2)) == "0000").alias("is_stored"))
    return containers.unpack(told, "mime", "is_stored").groupBy("parent_id", "mime", "is_stored").agg(F.count("*").alias("members"))


@query(f"with {_MEMBERS_SQL} select conv_id::varchar as parent_id, count(*) as saved from m group by conv_id")
def q53_member_counts(spark, sf_dir):
    return containers.unpack(containers.pack(_members(spark, sf_dir).withColumn("format", F.lit("tar")))).groupBy("parent_id").agg(F.count("*").alias("saved"))


@query("select page_id::varchar as parent_id, 'zip: ' || case page_id % 2 when 0 then 'broken' else 'whole' end as state from pages")
def q54_corrupt_containers(spark, sf_dir):
    zipped = _map(lambda i, t: samples.zip_file([("a.txt", t.encode())])[: None if i % 2 else 40], "binary")
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("parent_id"), F.lit("zip").alias("format"), zipped(F.col("page_id"), F.col("html")).alias("content"))
    return containers.unpack(p).select("parent_id", F.concat(F.lit("zip: "), F.when(F.col("error").isNotNull(), "broken").otherwise("whole")).alias("state"))


# PDF

_PDF_KEYS = (("/Type /Metadata", ".xml"), ("/Subtype /Form", ".form"), ("/Foo /Bar", ".bin"))


def _pdfs(spark, sf_dir: str) -> DataFrame:
    make = _map(lambda i, t: samples.pdf_file(t.encode(), _PDF_KEYS[i % 3][0].encode()), "binary")
    return _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), make(F.col("page_id"), F.col("html")).alias("content"))


@query("select page_id::varchar as path, 4 as obj_id, true as decodable, ['.xml', '.form', '.bin'][page_id % 3 + 1] as ext, md5(html) as digest from pages")
def q55_pdf_streams(spark, sf_dir):
    return media.pdf_streams(_pdfs(spark, sf_dir)).select("path", "obj_id", "decodable", "ext", _md5("content").alias("digest"))


@query("select page_id::varchar as path, true as equal, true as no_larger, false as equal_if_changed from pages")
def q56_pdf_recompress(spark, sf_dir):
    def judge(data: bytes) -> tuple:
        new = pdf.recompressed(data)
        return registry.raw_equal("pdf", data, new), len(new) <= len(data), registry.raw_equal("pdf", data, new.replace(b"/Count 1", b"/Count 2"))

    out = _pdfs(spark, sf_dir).select("path", _map(judge, "struct<equal: boolean, no_larger: boolean, equal_if_changed: boolean>")(F.col("content")).alias("r"))
    return out.select("path", "r.*")


# Sound

@query("select page_id::varchar as path, true as equal, true as smaller, false as equal_if_changed, false as equal_if_moved, md5(html) as digest from pages")
def q99_pdf_references(spark, sf_dir):
    def judge(i: int, text: str) -> tuple:
        data = samples.pdf_with_references(text.encode(), i % 2 > 0)
        new = pdf.recompressed(data)
        same = [registry.raw_equal("pdf", data, other) for other in (new, new.replace(b"/Size 7", b"/Size 8"), new.replace(b"startxref\n", b"startxref\n1"))]
        return same[0], len(new) < len(data), same[1], same[2], containers.pdf_streams(new)[4][1]

    made = _map(judge, "struct<equal: boolean, smaller: boolean, equal_if_changed: boolean, equal_if_moved: boolean, content: binary>")(F.col("page_id"), F.col("html"))
    out = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), made.alias("r")).select("path", "r.*")
    return out.select("path", "equal", "smaller", "equal_if_changed", "equal_if_moved", F.md5("content").alias("digest"))


def _sounds(spark, sf_dir: str) -> DataFrame:
    make = _map(lambda i, t: samples.sound(samples.SOUNDS[i % 7], t.encode()), "binary")
    return _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id", make(F.col("page_id"), F.col("html")).alias("content"))


@query("""select page_id::varchar as parent, 0 as seq, case page_id % 7 when 4 then '' else 'image/png' end as mime_type, case page_id % 7 when 5 then '' else 'd' end as description,
    3 as picture_type, case page_id % 7 when 4 then '.jpg' else '.png' end as ext, md5(html) as digest from pages""")
def q57_covers(spark, sf_dir):
    return media.covers(_sounds(spark, sf_dir)).select("parent", "seq", "mime_type", "description", "picture_type", "ext", _md5("content").alias("digest"))


@query("select page_id::varchar as path, md5(substr(html, 1, 10)) as digest, true as rest_equal from pages")
def q58_cover_write_back(spark, sf_dir):
    def swap(data: bytes) -> tuple:
        new = audio.with_pictures(data, [p[3].decode()[:10].encode() for p in audio.pictures(data)])
        return audio.pictures(new)[0][3], audio.without_pictures(new) == audio.without_pictures(data)

    out = _sounds(spark, sf_dir).select("path", _map(swap, "struct<cover: binary, rest_equal: boolean>")(F.col("content")).alias("r"))
    return out.select("path", F.md5("r.cover").alias("digest"), "r.rest_equal")


def _placeholder(processor: str, place: int) -> None:
    def run(spark, sf_dir):
        same = _map(lambda data: registry.CODECS[processor].encode(data, True) == data and registry.raw_equal(processor, data, data), "boolean")
        return _sounds(spark, sf_dir).where(F.pmod("page_id", F.lit(7)) == place).select("path", same(F.col("content")).alias("unchanged"))

    run.__name__ = f"q59_{processor}_placeholder"
    query(f"select page_id::varchar as path, true as unchanged from pages where page_id % 7 = {place}")(run)


for _processor, _place in (("mpeg", 1), ("wav", 2), ("aiff", 3), ("mp4", 5)):
    _placeholder(_processor, _place)


@query("select page_id, true as equal, true as smaller, false as equal_to_other from pages")
def q60_mkv_clean(spark, sf_dir):
    def judge(text: str) -> tuple:
        data = samples.video(text.encode())
        new = registry.CODECS["mkv"].encode(data, True)
        return registry.raw_equal("mkv", data, new), len(new) < len(data) - 100, registry.raw_equal("mkv", data, samples.video(text.encode() + b"!"))

    return _t(spark, sf_dir, "pages").select("page_id", _map(judge, "struct<equal: boolean, smaller: boolean, equal_to_other: boolean>")(F.col("html")).alias("r")).select("page_id", "r.*")


@query("select page_id::varchar as path, true as equal, true as smaller, false as equal_to_other from pages where page_id % 7 = 6")
def q60_ogg_remux(spark, sf_dir):
    def judge(data: bytes) -> tuple:
        new = audio.remuxed(data)
        return registry.raw_equal("ogg", data, new), len(new) < len(data), registry.raw_equal("ogg", data, samples.sound("ogg", b"other"))

    out = _sounds(spark, sf_dir).where(F.pmod("page_id", F.lit(7)) == 6).select("path", _map(judge, "struct<equal: boolean, smaller: boolean, equal_to_other: boolean>")(F.col("content")).alias("r"))
    return out.select("path", "r.*")


_INTS = "list_transform(embedding, lambda x: floor(x::double * 1000)::bigint)"


def _series(spark, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(1000.0)).cast("int")).alias("samples"))


@query(f"select vec_id::varchar as path, len(embedding) as n, list_sum({_INTS})::bigint as total, true as equal, true as smaller, true as digest_ok from embeddings")
def q61_flac_lossless(spark, sf_dir):
    from .codecs import flac

    def judge(values) -> tuple:
        data = flac.write(flac.Sound(8000, 24, np.array(values, np.int64)[:, None], [(flac.PADDING, bytes(200))]))
        new = flac.encode(data)
        sound = flac.decode(new)
        return len(sound.samples), int(sound.samples.sum()), registry.raw_equal("flac", data, new), len(new) < len(data), sound.digest.hex(), new

    out = _series(spark, sf_dir).select("path", "samples", _map(judge, "struct<n: bigint, total: bigint, equal: boolean, smaller: boolean, digest: string, content: binary>")(F.col("samples")).alias("r"))
    return out.select("path", "r.n", "r.total", "r.equal", "r.smaller", (scalar.flac_md5(F.col("r.content")) == F.col("r.digest")).alias("digest_ok"))


@query(f"select vec_id::varchar as path, 'XX_STA_00_BHZ' as sid, len(embedding) as samplecnt, list_sum({_INTS})::bigint as total, true as equal from embeddings")
def q62_seismic_repack(spark, sf_dir):
    from .codecs import mseed

    make = _map(lambda values: samples.seismic_file([int(v) for v in values]), "binary")
    repack = _map(lambda data: (lambda new: (new, registry.raw_equal("mseed", data, new)))(mseed.repacked(data)), "struct<content: binary, equal: boolean>")
    made = _series(spark, sf_dir).select("path", repack(make(F.col("samples"))).alias("r")).select("path", "r.content", "r.equal")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return media.seismic(made).groupBy("path", "sid").agg(F.sum("samplecnt").alias("samplecnt"), F.sum(total).alias("total")).join(made.select("path", "equal"), "path")


# Images

_LEVELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::double + 4) * 31)))::bigint)"


def _levels(spark, sf_dir: str) -> DataFrame:
    clipped = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + F.lit(4.0)) * F.lit(31.0)))).cast("int")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", clipped).alias("levels"))


def _pixels(levels) -> np.ndarray:
    return np.array(levels, np.uint8).reshape(8, -1, 1).repeat(3, axis=2)


def _first_gray(processor: str, data: bytes) -> int:
    """The sum of the red samples of a decoded file."""
    from .codecs import images, tiff, webp

    if processor == "tiff":
        return int(tiff.decode(data)[0][2][..., 0].sum())
    if processor in ("gif", "flexigif"):  # the table is the gray scale
        return sum(sum(body) for kind, _, body in images.gif_parts(data) if kind == "image")
    decode = {"png": images.decode_png, "zopflipng": images.decode_png, "tga": images.decode_tga, "bmp": images.decode_bmp, "pnm": images.decode_pnm, "webp": webp.decode}[processor]
    return int(decode(data)[2][..., 0].sum())


def _lossless(processor: str) -> None:
    def judge(levels) -> tuple:
        pixels = _pixels(levels)
        data = samples.image(processor, pixels)
        new = registry.CODECS[processor].encode(data, True)
        return registry.raw_equal(processor, data, new), registry.raw_equal(processor, data, samples.image(processor, pixels ^ 1)), 0 < len(new), _first_gray(processor, new)

    def run(spark, sf_dir):
        out = _levels(spark, sf_dir).select("vec_id", _map(judge, "struct<equal: boolean, equal_to_other: boolean, not_empty: boolean, total: bigint>")(F.col("levels")).alias("r"))
        return out.select("vec_id", "r.*")

    run.__name__ = f"q63_{processor}_lossless"
    query(f"select vec_id, true as equal, false as equal_to_other, true as not_empty, list_sum({_LEVELS})::bigint as total from embeddings")(run)


for _processor in ("png", "zopflipng", "gif", "flexigif", "tga", "bmp", "pnm", "tiff", "webp"):
    _lossless(_processor)


def _jpegs(spark, sf_dir: str) -> DataFrame:
    make = _map(lambda i: samples.jpeg_file(8 + i % 40, 16 + i % 24, i, 3 if i % 2 else 1, 2 if i % 3 == 0 else 0), "binary")
    return _t(spark, sf_dir, "pages").select("page_id", make(F.col("page_id")).alias("content"))


@query("select page_id, true as equal, true as smaller, false as equal_to_other, 8 + page_id % 40 as width, 16 + page_id % 24 as height, 8::bigint as depth, case page_id % 2 when 1 then 3 else 1 end::bigint as colors from pages")
def q64_jpeg_lossless(spark, sf_dir):
    def judge(data: bytes) -> tuple:
        new = registry.CODECS["jpeg"].encode(data, True)
        return new, registry.raw_equal("jpeg", data, new), len(new) < len(data), registry.raw_equal("jpeg", data, samples.jpeg_file(8, 16, -1 % 99))

    out = _jpegs(spark, sf_dir).select("page_id", _map(judge, "struct<content: binary, equal: boolean, smaller: boolean, equal_to_other: boolean>")(F.col("content")).alias("r"))
    return out.select("page_id", "r.equal", "r.smaller", "r.equal_to_other", scalar.jpeg_size(F.col("r.content")).alias("s")).select("page_id", "equal", "smaller", "equal_to_other", "s.*")


_hex = lambda n, digits: F.lpad(F.hex(n.cast("bigint")), digits, "0")


def _little(n: Column, size: int) -> Column:
    whole = _hex(n, 2 * size)
    return F.concat(*[F.substring(whole, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


@query("select page_id, 1 + page_id * 7 % 9000 as width, 1 + page_id * 11 % 8000 as height from pages")
def q65_webp_sizes(spark, sf_dir):
    n = F.col("page_id")
    w, h = 1 + n * 7 % 9000, 1 + n * 11 % 8000
    head = F.concat(F.lit("5249464600000000"), F.lit("57454250"))
    extended = F.concat(F.lit("56503858"), F.lit("0A000000"), F.lit("00000000"), _little(w - 1, 3), _little(h - 1, 3))
    lossless = F.concat(F.lit("5650384C"), F.lit("0A000000"), F.lit("2F"), _little((w - 1).bitwiseOR(F.shiftleft((h - 1).cast("bigint"), 14)), 4))
    lossy = F.concat(F.lit("56503820"), F.lit("0A000000"), F.lit("000000"), F.lit("9D012A"), _little(w, 2), _little(h, 2))
    kind = F.pmod(n, F.lit(3))
    content = F.unhex(F.concat(head, F.when(kind == 0, extended).when(kind == 1, lossless).otherwise(lossy)))
    return _t(spark, sf_dir, "pages").select("page_id", scalar.webp_size(content).alias("s")).select("page_id", "s.*")


@query("select vec_id, 8::bigint as width, len(embedding) // 8 as height, 8::bigint as depth, 2::bigint as color_type from embeddings")
def q66_png_sizes(spark, sf_dir):
    make = _map(lambda levels: samples.image("png", _pixels(levels).transpose(1, 0, 2)), "binary")
    return _levels(spark, sf_dir).select("vec_id", scalar.png_size(make(F.col("levels"))).alias("s")).select("vec_id", "s.*")


# Scalars

@query("""select event_id, (v & 65504) = 65504 and (v & 6) = 2 as layer3 from (select event_id, (event_id * 7 + 65000) % 65536 as v from events)""")
def q67_mp3_layer(spark, sf_dir):
    head = F.unhex(_hex((F.col("event_id") * 7 + 65000) % 65536, 4))
    return _t(spark, sf_dir, "events").select("event_id", scalar.is_mp3_layer3(F.concat(head, F.lit(b"xyz"))).alias("layer3"))


@query("select doc_id, doc_id % 3 = 0 as vorbis from documents")
def q68_vorbis_sniff(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(3))
    page = F.concat(F.lit(b"OggS" + bytes(22)), F.lit(b"\x01\x1e"), F.when(k == 0, F.lit(b"\x01vorbis")).when(k == 1, F.lit(b"OpusHead")).otherwise(F.lit(b"\x7fFLAC")), F.col("text").cast("binary"))
    return _t(spark, sf_dir, "documents").select("doc_id", scalar.is_vorbis(page).alias("vorbis"))


@query("""select doc_id, regexp_extract(p, '([^/]*)$', 1) as base, regexp_extract(regexp_extract(p, '([^/]*)$', 1), '^(.*)[.][^.]*$', 1) as stem, regexp_replace(p, '/?[^/]*$', '') as parent,
    case when starts_with(p, 'root/' || source || '/') then substr(p, length('root/' || source || '/') + 1) else p end as below from (select doc_id, source, 'root/' || source || '/' || doc_id || '.' || lang as p from documents)""")
def q69_path_parts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("root/"), _doc_path()).alias("p"))
    p = F.col("p")
    below = scalar.relative_to(F.regexp_replace(p, F.concat(F.lit("^root/"), F.col("source"), F.lit("/")), F.lit("root/here/")), "root/here")
    return d.select("doc_id", scalar.basename(p).alias("base"), scalar.stem(p).alias("stem"), scalar.parent(p).alias("parent"), below.alias("below"))


@query("select page_id, url as plain from pages")
def q70_strip_ansi(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;32m"), F.substring("url", 1, 9), F.lit("\x1b[0m"), F.expr("substring(url, 10)"), F.lit("\x1b[m"))
    return _t(spark, sf_dir, "pages").select("page_id", scalar.strip_ansi(coloured).alias("plain"))


_ETA_SQL = "select event_id, event_id % 100 as done, 100 as total, (event_id % 53 + 1)::double as elapsed from events"


@query(f"""select event_id, case when done = 0 then '--:--' else case when s >= 3600 then (s // 3600) || 'h ' else '' end || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm ' || lpad((s % 60)::varchar, 2, '0') || 's' end as eta,
    100.0::double * done / total as percent from (select *, case when done > 0 then floor((total - done) / (done / elapsed))::bigint end as s from ({_ETA_SQL}))""")
def q71_progress_text(spark, sf_dir):
    done, elapsed = F.pmod("event_id", F.lit(100)), (F.pmod("event_id", F.lit(53)) + 1).cast("double")
    return _t(spark, sf_dir, "events").select("event_id", scalar.eta_text(done, F.lit(100), elapsed).alias("eta"), scalar.progress_percent(done, F.lit(100)).alias("percent"))


_COVER_MIMES = ("image/png", "image/jpeg", "image/webp", "image/gif", "")


@query(f"""select page_id, case m when 'image/png' then '.png' when 'image/webp' then '.webp' else '.jpg' end as ext, case m when 'image/png' then 14 else 13 end as format,
    case when page_id % 6 = 4 then 'Cover Art (Back)' else 'Cover Art (Front)' end as ape_key, case when page_id % 6 = 4 then 4 else 3 end as position from (select page_id, {_pick_sql(_COVER_MIMES, 'page_id')} as m from pages)""")
def q72_cover_maps(spark, sf_dir):
    mime, key = _pick(_COVER_MIMES, F.col("page_id")), scalar.cover_key(F.pmod("page_id", F.lit(6)))
    return _t(spark, sf_dir, "pages").select("page_id", scalar.picture_extension(mime).alias("ext"), scalar.cover_format(mime).alias("format"), key.alias("ape_key"), scalar.cover_position(key).alias("position"))


@query("select page_id, case when page_id % 3 > 0 and page_id % 4 > 0 then 'Extracted' when page_id % 2 = 0 then 'Extraction resulted in no elements' else 'Extraction failed' end as outcome from pages")
def q73_extraction_outcome(spark, sf_dir):
    n = lambda k: F.pmod("page_id", F.lit(k))
    return _t(spark, sf_dir, "pages").select("page_id", select.extraction_outcome(n(4), n(3) == 0, n(2) == 0).alias("outcome"))


@query("select page_id, case when page_id % 5 > 0 then strlen(html) else -1 end as size from pages")
def q74_pipe_sizes(spark, sf_dir):
    sizes = F.array(F.octet_length("html") + 9, F.when(F.pmod("page_id", F.lit(5)) > 0, 7).otherwise(0), F.octet_length("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(select.pipe_sizes(sizes), F.lit(-1)).alias("size"))


@query("select conv_id::varchar as parent_id, turn::int as seq, md5(case when turn % 2 = 0 then upper(role) else text end) as digest from conversations")
def q75_reassociate(spark, sf_dir):
    m = _members(spark, sf_dir).select("parent_id", "seq", "content")
    new = _t(spark, sf_dir, "conversations").where("turn % 2 = 0").select(F.col("conv_id").cast("string").alias("parent_id"), F.col("turn").cast("int").alias("seq"), F.upper("role").cast("binary").alias("content"))
    return lookup.reassociate(m, new).select("parent_id", "seq", _md5("content").alias("digest"))


@query("select doc_id, row_number() over (partition by source order by doc_id % 50, doc_id)::int as rank from documents")
def q76_natural_order(spark, sf_dir):
    number = F.pmod("doc_id", F.lit(50)).cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.pmod("doc_id", F.lit(3)).cast("int")), number)
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("p"), padded, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return order.natural_rank(rows, "source", "name").select("doc_id", "rank")


@query("select page_id, url, row_number() over (order by url, page_id)::int as rank from pages")
def q98_sort_by_path(spark, sf_dir):
    return order.path_rank(_t(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id")


# Tables of formats and processors

@query(f"select * from {dims.values_sql([(p[0], i, p[1], p[2]) for i, p in enumerate(dims.PROCESSORS)], 't(processor, priority, can_recompress, can_extract)')}")
def q77_processors(spark, sf_dir):
    return dims.processor_dim(spark)


_FORMATS = [(n, True, n not in dims.READ_ONLY) for n in dict.fromkeys(dims.FORMAT_ALIASES.values())] + [("unknown", False, False)]


@query(f"select doc_id, format, readable, writable from (select doc_id, {_pick_sql(tuple(f[0] for f in _FORMATS), 'doc_id')} as f from documents) join {dims.values_sql(_FORMATS, 't(format, readable, writable)')} on f = format")
def q78_format_abilities(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", _pick(tuple(f[0] for f in _FORMATS), F.col("doc_id")).alias("format"))
    return d.join(F.broadcast(dims.format_dim(spark)), "format").select("doc_id", "format", "readable", "writable")


@query(f"with {_PAGE_FILES} select page_id, processor, priority from files join {_PROC_EXTS} on {_PAGE_EXT} = pext")
def q79_registry_by_extension(spark, sf_dir):
    return lookup.by_extension(_page_files(spark, sf_dir)).select("page_id", "processor", "priority")


@query(f"""with {_PAGE_FILES} select page_id, coalesce(format, 'unknown') as format from (select page_id, {_PAGE_EXT} as e from files) left join {dims.values_sql(dims.EXT_MIMES.items(), 'x(ext, mime)')} on e = ext
    left join {dims.values_sql(dims.MIME_FORMATS.items(), 'm(mime2, format)')} on mime = mime2""")
def q80_extension_to_format(spark, sf_dir):
    mimes, formats = dims.ext_map(spark).select(F.col("ext").alias("_e"), F.col("mime").alias("_m")), dims.mime_map(spark).select(F.col("mime").alias("_m2"), "format")
    p = _page_files(spark, sf_dir).select("page_id", scalar.extension(F.col("path")).alias("e"))
    return p.join(F.broadcast(mimes), F.col("e") == F.col("_e"), "left").join(F.broadcast(formats), F.col("_m") == F.col("_m2"), "left").select("page_id", F.coalesce("format", F.lit("unknown")).alias("format"))


@query(f"""with {_PAGE_FILES} select page_id, bool_or(r) as recompress, bool_or(x) as extract from files join {_PROC_EXTS} on {_PAGE_EXT} = pext
    join {dims.values_sql([(p[0], p[1], p[2]) for p in dims.PROCESSORS], 'd(processor2, r, x)')} on processor = processor2 group by page_id""")
def q81_capabilities(spark, sf_dir):
    found = lookup.by_extension(_page_files(spark, sf_dir)).select("page_id", "processor")
    return found.join(F.broadcast(dims.processor_dim(spark)), "processor").groupBy("page_id").agg(F.bool_or("can_recompress").alias("recompress"), F.bool_or("can_extract").alias("extract"))


# Sources and sinks

def _written_files(spark, sf_dir: str, name: Column, folder: str) -> None:
    """The names of nations, written as files by the file sink's tasks, each into its own folder."""
    n = _t(spark, sf_dir, "nation").select(name.alias("path"), F.col("n_name").cast("binary").alias("content"))
    paths = n.select(F.concat(F.lit(folder + "/"), "path").alias("path"), "content")
    assert files.write_files(paths, None, True).count() == n.count()


@query("select 'n' || n_nationkey || '.txt' as name, strlen(n_name) as length, md5(n_name) as digest from nation where n_nationkey % 5 > 0")
def q82_flat_scan(spark, sf_dir):
    folder, k = shared_folder(spark), F.col("n_nationkey")
    _written_files(spark, sf_dir, F.concat(F.when(k % 5 == 0, "below/").otherwise(""), F.lit("n"), k.cast("string"), F.lit(".txt")), folder)
    found = scan.contents(scan.scan(spark, [folder, f"{folder}/missing"]))
    return found.select(scalar.basename(F.col("path")).alias("name"), "length", _md5("content").alias("digest"))


@query("select case when n_nationkey % 2 = 0 then 'a/b/' else '' end || '_n' || n_nationkey || '.txt' as name, strlen(n_name) as length from nation where n_nationkey % 5 > 0")
def q83_recursive_scan(spark, sf_dir):
    folder, k = shared_folder(spark), F.col("n_nationkey")
    _written_files(spark, sf_dir, F.concat(F.when(k % 2 == 0, "a/b/").otherwise(""), F.when(k % 5 == 0, "._n").otherwise("_n"), k.cast("string"), F.lit(".txt")), folder)
    return scan.scan(spark, [folder], recursive=True).select(scalar.relative_to(F.col("path"), folder).alias("name"), "length")


@query("select 'n' || n_nationkey || '.txt' as name, strlen(n_name) as length from nation")
def q84_store_scan(spark, sf_dir):
    folder = shared_folder(spark)
    _written_files(spark, sf_dir, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt")), folder)
    return scan.scan_tree(spark, folder).select(scalar.basename(F.col("path")).alias("name"), "length")


@query("select 'n' || n_nationkey || '.txt' as name, md5(n_name) as digest from nation")
def q85_arriving_files(spark, sf_dir):
    folder, out = shared_folder(spark), shared_folder(spark)
    _written_files(spark, sf_dir, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt")), folder)
    stream = arriving_files(spark, folder).select(scalar.basename(F.col("path")).alias("name"), _md5("content").alias("digest"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema("name string, digest string").parquet(f"{out}/rows")


@query("select 'stdin.bin' as path, strlen(t) as length, md5(t) as digest from (select string_agg(r_name, ',' order by r_regionkey) as t from region)")
def q86_standard_input(spark, sf_dir):
    data = ",".join(r.r_name for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()).encode()
    return scan.stdin_files(spark, data).select("path", F.octet_length("content").cast("bigint").alias("length"), _md5("content").alias("digest"))


_CSV_SQL = f"""with {_RESULTS_SQL} select path as "File", '' as "Container", 'text/html' as "MIME", size_before // 1024 as "Before", size_after // 1024 as "After",
    case when success and size_before > 0 then 100.0::double * (1.0::double - size_after / size_before) else 0.0::double end as delta, '0.50' as seconds,
    case when not success then 'FAIL' when replaced then 'OK (replaced)' else 'OK (skipped)' end as result, 'png:12.00%' as codecs, 'bad, "worse"' as error from results"""


@query(_CSV_SQL)
def q87_csv_report(spark, sf_dir):
    folder = shared_folder(spark)
    codecs = F.array(F.struct(F.lit("png").alias("name"), F.lit(12.0).alias("pct")))
    r = _results(spark, sf_dir).withColumn("container_origin", F.lit(None).cast("string")).withColumn("seconds", F.lit(0.5)).withColumn("codecs_used", codecs).withColumn("error_msg", F.lit('bad, "worse"')).withColumn("format", F.lit("zip"))
    csv_report.write_parts(r, r.select(F.col("path").alias("filename"), "format", "size_before", "size_after", "success", "error_msg"), folder, "pipe")
    back = csv_report.read_files(spark, folder)
    exact = _results(spark, sf_dir).select(F.col("path").alias("File"), scalar.kilobytes(F.col("size_before")).alias("before"), scalar.kilobytes(F.col("size_after")).alias("after"), scalar.outcome(F.col("success"), F.col("replaced")).alias("outcome"), scalar.delta_percent(F.col("size_before"), F.col("size_after"), F.col("success")).alias("exact"))
    # a path may stand in several rows: these are paired in the order of their cells, in which rounding changes nothing
    exact = exact.withColumn("copy", F.row_number().over(Window.partitionBy("File", "before", "after", "outcome").orderBy("exact")))
    cells = {"before": F.col("Before(KB)").cast("bigint"), "after": F.col("After(KB)").cast("bigint"), "outcome": F.col("Result")}
    back = back.withColumn("copy", F.row_number().over(Window.partitionBy("File", *cells.values()).orderBy(F.col("Delta(%)").cast("double"))))
    near = F.when(F.abs(F.col("Delta(%)").cast("double") - F.col("exact")) <= 0.0051, F.col("exact"))
    same = back["File"].eqNullSafe(exact["File"]) & (back["copy"] == exact["copy"])
    for name, cell in cells.items():
        same &= cell.eqNullSafe(exact[name])
    joined = back.join(exact, same).drop(exact["File"])
    return joined.select("File", F.coalesce("Container", F.lit("")).alias("Container"), "MIME", F.col("Before(KB)").cast("bigint").alias("Before"), F.col("After(KB)").cast("bigint").alias("After"), near.alias("delta"), F.col("Time(s)").alias("seconds"), F.col("Result").alias("result"), F.col("Codecs").alias("codecs"), F.col("Error").alias("error"))


@query("select i::bigint as line, case i when 0 then 'File' else r end as first_cell from (select row_number() over (order by r_name) as i, r_name as r from region union all select 0, null)")
def q88_console_table(spark, sf_dir):
    r = _t(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.lit(None).cast("string").alias("container_origin"), F.lit("x/y").alias("mime"), F.lit(9).cast("bigint").alias("size_before"), F.lit(8).cast("bigint").alias("size_after"), F.lit(0.5).alias("seconds"), F.lit(True).alias("success"), F.lit(True).alias("replaced"), F.array().cast("array<struct<name:string,pct:double>>").alias("codecs_used"), F.lit(None).cast("string").alias("error_msg"))
    lines = csv_report.console_table(r).split("\n")
    return spark.createDataFrame([(i, line.split("  ")[0].strip()) for i, line in enumerate(lines)], "line bigint, first_cell string")


# The engine

def _zips(spark, sf_dir: str, depth: int = 1) -> DataFrame:
    """A stored zip of each conversation's turns, inside as many more zips as asked for."""

    def pack(names, texts) -> bytes:
        data = samples.zip_file([(n, t.encode()) for n, t in zip(names, texts, strict=True)])
        for _ in range(depth - 1):
            data = samples.zip_file([("inner.zip", data)])
        return data

    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    names = F.transform("m", lambda m: F.concat(F.lit("turn"), m["turn"].cast("string"), F.lit(".txt")))
    return turns.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".zip")).alias("path"), _map(pack, "binary")(names, F.transform("m", lambda m: m["text"])).alias("content"))


@query("""select 'conv' || conv_id || '.zip' as path, null as container_origin, true as is_container, true as success, null as error_msg, -1 as size from conversations group by conv_id
    union all select 'conv' || conv_id || '.zip!turn' || turn || '.txt', 'conv' || conv_id || '.zip', false, true, 'Unsupported format', strlen(text) from conversations""")
def q89_engine_archives(spark, sf_dir):
    run = Engine(spark).mode("parallel").run_files(_zips(spark, sf_dir))
    return run.results.select("path", "container_origin", "is_container", "success", F.when(~F.col("is_container"), F.col("error_msg")).alias("error_msg"), F.when(~F.col("is_container"), F.col("size_before")).otherwise(-1).alias("size"))


@query("select 'conv' || conv_id || '.zip' as root, count(*) + 3 as files, 3 as containers, true as all_good from conversations group by conv_id")
def q90_engine_nested(spark, sf_dir):
    run = Engine(spark).run_files(_zips(spark, sf_dir, 3))
    root = F.coalesce("container_origin", "path")
    return run.results.groupBy(root.alias("root")).agg(F.count("*").alias("files"), F.count_if("is_container").cast("int").alias("containers"), F.bool_and("success").alias("all_good"))


def _art(spark, sf_dir: str) -> DataFrame:
    make = _map(lambda i, levels: samples.image("png", _pixels(levels))[: None if i % 7 else 60], "binary")
    return _levels(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), make(F.col("vec_id"), F.col("levels")).alias("content"))


@query("select 'v' || vec_id || '.png' as path, 'image/png' as mime, vec_id % 7 > 0 as success, vec_id % 7 > 0 as replaced, true as smaller_or_same from embeddings")
def q91_engine_images(spark, sf_dir):
    run = Engine(spark).mode("parallel").run_files(_art(spark, sf_dir))
    return run.results.select("path", "mime", "success", "replaced", (F.col("size_after") <= F.col("size_before")).alias("smaller_or_same"))


@query("select 'process' as phase, case when vec_id % 7 > 0 then 'complete' else 'error' end as kind, 'v' || vec_id || '.png' as path, vec_id % 7 > 0 as replaced, true as timed from embeddings")
def q92_engine_events(spark, sf_dir):
    run = Engine(spark).run_files(_art(spark, sf_dir))
    return run.events.select("phase", "kind", "path", "replaced", (F.col("duration_ms") >= 0).alias("timed"))


@query("select case n_nationkey % 3 when 0 then 'n' || n_nationkey || '.zip!x.png' when 1 then 'n' || n_nationkey || '.zip!y.txt' else 'n' || n_nationkey || '.zip!z.zip' end as path, n_nationkey % 3 = 0 as replaced from nation")
def q93_engine_write_back(spark, sf_dir):
    """Files on disk, run through the whole engine into a folder, and the written archives read again."""
    source, out = shared_folder(spark), shared_folder(spark)

    def pack(i, name) -> bytes:
        art = samples.image("png", np.arange(64, dtype=np.uint8).reshape(8, 8, 1).repeat(3, axis=2))
        inner = [("x.png", art), ("y.txt", name.encode() * 50), ("z.zip", samples.zip_file([("deep.txt", name.encode() * 9)], stored=False))][i % 3]
        return samples.zip_file([inner])

    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit(f"{source}/n"), F.col("n_nationkey").cast("string"), F.lit(".zip")).alias("path"), _map(pack, "binary")(F.col("n_nationkey"), F.col("n_name")).alias("content"))
    files.write_files(n, None, True).count()
    run = Engine(spark, Settings(output=out)).recompress([source])
    back = containers.unpack(scan.contents(scan.scan(spark, [out])).select(scalar.basename(F.col("path")).alias("parent_id"), F.lit("zip").alias("format"), "content"))
    members = back.select(F.concat_ws("!", "parent_id", "rel_path").alias("path"), F.octet_length("content").alias("now"))
    results = run.results.where("container_origin is not null").select(scalar.basename(F.col("path")).alias("path"), "size_after", "replaced")
    return results.join(members, "path").where("now = size_after").select("path", "replaced")


@query("select kind, n::bigint as n from (values ('start', 25 * 2), ('finish', 25 * 2 - 25), ('skipped', 25), ('error', 0), ('logged', 1)) as t(kind, n)")
def q94_observer(spark, sf_dir):
    """What an observer hears of a run over a zip for each nation, with one text in it."""
    heard = {"start": 0, "finish": 0, "skipped": 0, "error": 0, "logged": 0}

    class Watch:
        def on_file_start(self, path):
            heard["start"] += 1

        def on_file_finish(self, path, before, after, replaced):
            heard["finish" if before else "skipped"] += 1

        def on_file_error(self, path, message):
            heard["error"] += 1

        def on_log(self, level, message):
            heard["logged"] = 1

    make = _map(lambda name: samples.zip_file([("a.txt", name.encode() * 50)]), "binary")
    n = _t(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".zip")).alias("path"), make(F.col("n_name")).alias("content"))
    engine = Engine(spark).set_observer(Watch())
    engine.clean(engine.run_files(n))
    return spark.createDataFrame(list(heard.items()), "kind string, n bigint")


_OPTIONS = (("mode", "pipe", True), ("mode", "parallel", True), ("mode", "both", False), ("log_level", "error", True), ("log_level", "loud", False), ("partitions", 4, True), ("partitions", 0, False), ("max_depth", -1, False))


@query(f"select * from {dims.values_sql([(n, str(v), ok) for n, v, ok in _OPTIONS], 't(name, value, valid)')}")
def q95_option_checks(spark, sf_dir):
    def valid(name, value) -> bool:
        try:
            Settings(**{name: value})
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, str(v), valid(n, v)) for n, v, _ in _OPTIONS], "name string, value string, valid boolean")


@query("select vec_id, true as equal, true as same_checksum, true as smaller from embeddings")
def q96_sql_functions(spark, sf_dir):
    sql_functions.register(spark)
    _levels(spark, sf_dir).select("vec_id", _map(lambda levels: samples.image("png", _pixels(levels)), "binary")(F.col("levels")).alias("content")).createOrReplaceTempView("art")
    return spark.sql("""select vec_id, raw_equal('png', content, small) as equal, content_checksum('png', content) = content_checksum('png', small) as same_checksum, octet_length(small) < octet_length(content) as smaller
        from (select vec_id, content, recompressed('png', content) as small from art)""")


@query("select 'process' as step, count(*) as n from embeddings union all select 'leaf', count(*) from embeddings")
def q97_registered_codec(spark, sf_dir):
    """A codec put into a free slot is used by the engine, and then taken out again."""
    make = _map(lambda i: b"wvpk" + bytes(50 + i % 9), "binary")
    rows = _t(spark, sf_dir, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wv")).alias("path"), make(F.col("vec_id")).alias("content"))
    registry.register_codec("wavpack", lambda data, keep: data.rstrip(b"\0"), lambda data: data.rstrip(b"\0"))
    try:
        run = Engine(spark).run_files(rows)
    finally:
        del registry.CODECS["wavpack"]
    done = run.results.where("replaced and size_after = 4")
    return done.agg(F.count("*").alias("n")).select(F.lit("leaf").alias("step"), "n").unionByName(run.events.where("phase = 'process'").agg(F.count("*").alias("n")).select(F.lit("process").alias("step"), "n"))


__all__ = ["ORACLE_SQL", "QUERIES"]
