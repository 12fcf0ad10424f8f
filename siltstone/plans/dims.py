"""The dimension tables of the engine: formats, content types and processors. All are small and of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Content type -> container format. Where a type could mean two formats, the first one holds.
MIME_FORMATS = {
    "application/zip": "zip",
    "application/x-zip-compressed": "zip",
    "application/x-7z-compressed": "7z",
    "application/x-tar": "tar",
    "application/gzip": "gz",
    "application/x-bzip2": "bz2",
    "application/x-xz": "xz",
    "application/vnd.rar": "rar",
    "application/x-rar-compressed": "rar",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "pptx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.graphics": "odg",
    "application/vnd.oasis.opendocument.formula": "odf",
    "application/pdf": "pdf",
    "application/x-ms-wim": "wim",
    "application/epub+zip": "epub",
    "application/vnd.comicbook+zip": "cbz",
    "application/vnd.comicbook+tar": "cbt",
    "application/java-archive": "jar",
    "application/x-xpinstall": "xpi",
    "image/openraster": "ora",
    "model/vnd.dwfx+xps": "dwfx",
    "application/vnd.ms-xpsdocument": "xps",
    "application/oxps": "xps",
    "application/vnd.android.package-archive": "apk",
    "application/x-iso9660-image": "iso",
    "application/x-cpio": "cpio",
    "application/x-archive": "a",
    "application/zstd": "zst",
    "application/x-zstd": "zst",
    "application/vnd.comicbook+rar": "rar",
    "application/x-cbr": "rar",
    "application/vnd.ms-package.3dmanufacturing-3dmodel+xml": "zip",
    "application/vnd.google-earth.kmz": "zip",
    "application/vsix": "zip",
}

# Names and aliases of formats -> the name that is printed.
FORMAT_ALIASES = {
    "zip": "zip", "7z": "7z", "tar": "tar", "gz": "gz", "gzip": "gz", "bz2": "bz2", "bzip2": "bz2", "xz": "xz", "wim": "wim", "rar": "rar",
    "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "ods": "ods", "odt": "odt", "odp": "odp", "odg": "odg", "odf": "odf",
    "epub": "epub", "cbt": "cbt", "cbz": "cbz", "jar": "jar", "xpi": "xpi", "ora": "ora", "dwfx": "dwfx", "pdf": "pdf",
    "xps": "xps", "oxps": "xps", "apk": "apk", "iso": "iso", "cpio": "cpio", "a": "a", "ar": "a", "lib": "a",
    "zst": "zst", "zstd": "zst", "tzst": "zst", "3mf": "zip", "kmz": "zip", "vsix": "zip", "nupkg": "zip", "war": "jar", "ear": "jar", "aab": "apk",
}

#: Formats that can be read but not written again.
READ_ONLY = ("7z", "rar", "wim")

# File extension -> content type.
EXT_MIMES = {
    ".zip": "application/zip",
    ".7z": "application/x-7z-compressed",
    ".cb7": "application/x-7z-compressed",
    ".tar": "application/x-tar",
    ".gz": "application/gzip",
    ".bz2": "application/x-bzip2",
    ".xz": "application/x-xz",
    ".wim": "application/x-ms-wim",
    ".rar": "application/vnd.rar",
    ".cbr": "application/vnd.comicbook+rar",
    ".iso": "application/x-iso9660-image",
    ".cpio": "application/x-cpio",
    ".lzma": "application/x-lzma",
    ".cab": "application/vnd.ms-cab-compressed",
    ".epub": "application/epub+zip",
    ".cbz": "application/vnd.comicbook+zip",
    ".cbt": "application/vnd.comicbook+tar",
    ".jar": "application/java-archive",
    ".xpi": "application/x-xpinstall",
    ".ora": "image/openraster",
    ".dwfx": "model/vnd.dwfx+xps",
    ".xps": "application/vnd.ms-xpsdocument",
    ".oxps": "application/oxps",
    ".apk": "application/vnd.android.package-archive",
    ".3mf": "application/vnd.ms-package.3dmanufacturing-3dmodel+xml",
    ".kmz": "application/vnd.google-earth.kmz",
    ".vsix": "application/zip",
    ".nupkg": "application/zip",
    ".war": "application/java-archive",
    ".ear": "application/java-archive",
    ".aab": "application/vnd.android.package-archive",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".jxl": "image/jxl",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".doc": "application/msword",
    ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
    ".odg": "application/vnd.oasis.opendocument.graphics",
    ".odf": "application/vnd.oasis.opendocument.formula",
    ".pdf": "application/pdf",
    ".sqlite": "application/vnd.sqlite3",
    ".db": "application/vnd.sqlite3",
    ".flac": "audio/flac",
    ".wv": "audio/x-wavpack",
    ".wvp": "audio/x-wavpack",
    ".wvc": "audio/x-wavpack",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".ape": "audio/x-ape",
    ".mkv": "video/x-matroska",
    ".webm": "video/webm",
    ".mseed": "application/vnd.fdsn.mseed",
}
DEFAULT_MIME = "application/octet-stream"

# Processors in registration order: name, recompresses, extracts, content types, extensions.
PROCESSORS = (
    ("flac", True, True, ("audio/flac", "audio/x-flac"), (".flac",)),
    ("wavpack", True, False, ("audio/x-wavpack",), (".wv", ".wvp", ".wvc")),
    ("ape", True, True, ("audio/ape", "audio/x-ape"), (".ape",)),
    ("jpeg", True, False, ("image/jpeg",), (".jpg", ".jpeg", ".jpe")),
    ("png", True, False, ("image/png",), (".png",)),
    ("zopflipng", True, False, ("image/png",), (".png",)),
    ("webp", True, False, ("image/webp",), (".webp",)),
    ("gif", True, False, ("image/gif",), (".gif",)),
    ("tga", True, False, ("image/tga", "image/x-tga"), (".tga", ".targa")),
    ("flexigif", True, False, ("image/gif",), (".gif",)),
    ("tiff", True, False, ("image/tiff",), (".tif", ".tiff")),
    ("jxl", True, False, ("image/jxl",), (".jxl",)),
    ("pdf", False, True, ("application/pdf",), (".pdf",)),
    ("archive", False, True, ("application/zip", "application/x-tar", "application/x-bzip2", "application/x-iso9660-image", "application/x-cpio", "application/vnd.ms-cab-compressed", "application/java-archive", "application/x-xpinstall", "application/vnd.android.package-archive", "application/vnd.comicbook+zip", "application/vnd.comicbook+tar", "application/epub+zip", "application/x-archive", "application/zstd", "application/x-zstd"), (".zip", ".tar", ".bz2", ".iso", ".cpio", ".lzma", ".cab", ".jar", ".xpi", ".apk", ".cbz", ".cbt", ".epub", ".a", ".ar", ".lib", ".zst", ".tzst")),
    ("ooxml", False, True, ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), (".docx", ".xlsx", ".pptx")),
    ("odf", False, True, ("application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.presentation", "application/vnd.oasis.opendocument.graphics"), (".odt", ".ods", ".odp", ".odg")),
    ("sqlite", True, False, ("application/x-sqlite3", "application/vnd.sqlite3"), (".sqlite", ".db", ".sqlite3")),
    ("mseed", True, False, ("application/vnd.fdsn.mseed",), (".mseed", ".mseed2", ".mseed3")),
    ("mkv", True, True, ("video/x-matroska", "video/webm"), (".mkv", ".webm")),
    ("mpeg", False, True, ("audio/mpeg",), (".mp3",)),
    ("wav", False, True, ("audio/wav", "audio/x-wav", "audio/vnd.wave", "audio/wave"), (".wav",)),
    ("mp4", False, True, ("audio/mp4", "audio/x-m4a", "video/mp4"), (".mp4", ".m4a", ".m4b")),
    ("ogg", True, True, ("audio/ogg", "audio/vorbis", "audio/opus"), (".ogg", ".opus", ".oga")),
    ("aiff", False, True, ("audio/x-aiff", "audio/aiff"), (".aif", ".aiff", ".aifc")),
    ("bmp", True, False, ("image/bmp", "image/x-ms-bmp"), (".bmp", ".dib")),
    ("pnm", True, False, ("image/x-portable-anymap", "image/x-portable-pixmap"), (".ppm", ".pgm", ".pnm")),
)

#: Magic numbers (offset, hex, content type), in order of priority; from public format descriptions.
MAGIC = (
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (8, "57454250", "image/webp"),
    (0, "424D", "image/bmp"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (0, "0000000C4A584C20", "image/jxl"),
    (0, "FF0A", "image/jxl"),
    (0, "5033", "image/x-portable-pixmap"),
    (0, "5036", "image/x-portable-pixmap"),
    (0, "5032", "image/x-portable-anymap"),
    (0, "5035", "image/x-portable-anymap"),
    (0, "25504446", "application/pdf"),
    (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970", "application/epub+zip"),
    (30, "6D696D65747970656170706C69636174696F6E2F766E642E6F617369732E6F70656E646F63756D656E742E74657874", "application/vnd.oasis.opendocument.text"),
    (0, "504B0304", "application/zip"),
    (0, "504B0506", "application/zip"),
    (0, "377ABCAF271C", "application/x-7z-compressed"),
    (0, "526172211A07", "application/vnd.rar"),
    (0, "1F8B", "application/gzip"),
    (0, "425A68", "application/x-bzip2"),
    (0, "FD377A585A00", "application/x-xz"),
    (0, "28B52FFD", "application/zstd"),
    (257, "7573746172", "application/x-tar"),
    (0, "213C617263683E0A", "application/x-archive"),
    (0, "303730373031", "application/x-cpio"),
    (0, "303730373037", "application/x-cpio"),
    (32769, "4344303031", "application/x-iso9660-image"),
    (0, "4D53434600000000", "application/vnd.ms-cab-compressed"),
    (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    (0, "664C6143", "audio/flac"),
    (0, "7776706B", "audio/x-wavpack"),
    (0, "4D414320", "audio/x-ape"),
    (8, "57415645", "audio/wav"),
    (8, "41494646", "audio/aiff"),
    (0, "4F676753", "audio/ogg"),
    (0, "494433", "audio/mpeg"),
    (0, "FFFB", "audio/mpeg"),
    (4, "66747970", "video/mp4"),
    (0, "1A45DFA3", "video/x-matroska"),
    (0, "4D5303", "application/vnd.fdsn.mseed"),
    (6, "4420", "application/vnd.fdsn.mseed"),
)
#: Of these, what goes before the magic number must be a sequence number.
MAGIC_DIGITS = frozenset({(6, "application/vnd.fdsn.mseed")})


def mime_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIME_FORMATS.items()), "mime string, format string")


def ext_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXT_MIMES.items()), "ext string, mime string")


def format_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMAT_ALIASES.items()), "alias string, format string")


def format_dim(spark: SparkSession) -> DataFrame:
    names = dict.fromkeys(FORMAT_ALIASES.values())
    return spark.createDataFrame([(n, True, n not in READ_ONLY) for n in names] + [("unknown", False, False)], "format string, readable boolean, writable boolean")


def processor_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p[0], i, p[1], p[2]) for i, p in enumerate(PROCESSORS)], "processor string, priority int, can_recompress boolean, can_extract boolean")


def processor_mimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p[0], i, m) for i, p in enumerate(PROCESSORS) for m in p[3]], "processor string, priority int, mime string")


def processor_exts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p[0], i, e) for i, p in enumerate(PROCESSORS) for e in p[4]], "processor string, priority int, ext string")


def _grouped(which: int) -> list[tuple[str, list[tuple[int, str]]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for i, p in enumerate(PROCESSORS):
        for key in dict.fromkeys(p[which]):
            out.setdefault(key, []).append((i, p[0]))
    return list(out.items())


def processors_by_mime(spark: SparkSession) -> DataFrame:
    """One row per content type with its processors in order."""
    return spark.createDataFrame(_grouped(3), "mime string, processors array<struct<priority: int, processor: string>>")


def processors_by_ext(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_grouped(4), "ext string, processors array<struct<priority: int, processor: string>>")


def values_sql(rows, names: str) -> str:
    """Rows as a VALUES table of SQL, for the queries' SQL."""

    def lit(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as {names}"
