"""Files opened into rows."""

import struct

from siltstone.codecs.registry import raw_equal
from siltstone.codecs import jpeg
from siltstone.sources import media


def test_media(spark):
    picture = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 1) + b"d" + struct.pack(">IIIII", 1, 1, 8, 0, 4) + b"DATA"
    flac = b"fLaC" + b"\x86" + len(picture).to_bytes(3, "big") + picture
    pdf = b"%PDF-1.4\n7 0 obj\n<< /Subtype /Image /Filter /DCTDecode /Length 4 >>\nstream\nJPEG\nendstream\nendobj\n"
    head = b"000001D %-5s%-2s%-3s%-2s" % (b"STA", b"00", b"BHZ", b"XX") + struct.pack(">HHBBBBHHhhBBBBiHH", 2024, 5, 1, 2, 3, 0, 0, 2, 20, 1, 0, 0, 0, 1, 0, 64, 48) + struct.pack(">HHBBBB", 1000, 0, 3, 1, 9, 0)
    seismic = (head.ljust(64, b"\0") + struct.pack(">ii", 5, -7)).ljust(512, b"\0")
    df = spark.createDataFrame([("a", flac), ("b", pdf), ("c", seismic)], "path string, content binary")
    (cover,) = media.covers(df).collect()
    assert (cover.parent, cover.mime_type, bytes(cover.content), cover.ext) == ("a", "image/png", b"DATA", ".png")
    (stream,) = media.pdf_streams(df).collect()
    assert (stream.path, stream.obj_id, stream.decodable, stream.ext, bytes(stream.content)) == ("b", 7, False, ".jpg", b"JPEG")
    rows = {r.path: r for r in media.seismic(df).collect()}
    assert rows["c"].samples == [5.0, -7.0] and rows["c"].sid == "XX_STA_00_BHZ" and rows["a"].error


def test_jpeg_segments():
    part = lambda marker, body: bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body
    data = b"\xff\xd8" + part(0xE0, b"JFIF") + part(0xE1, b"exif") + part(0xFE, b"hi") + part(0xE1, b"exif") + part(0xDB, b"q") + b"\xff\xda" + b"scan\xff\xd9"
    small, bare = jpeg.without_repeats(data), jpeg.without_repeats(data, False)
    assert len(bare) < len(small) < len(data) and small.count(b"exif") == 1 and b"exif" not in bare
    assert raw_equal("jpeg", data, small) and raw_equal("jpeg", data, bare) and not raw_equal("jpeg", data, b"")
