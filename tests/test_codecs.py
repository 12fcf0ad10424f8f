"""Encoders keep the decoded content; containers keep their members."""

import re
import struct
import zlib

import numpy as np
import pytest

from siltstone.codecs import containers as C
from siltstone.codecs import images as I
from siltstone.codecs import mseed, pdf
from siltstone.codecs.registry import available, checksum, raw_equal, register_codec
from siltstone.codecs.sqlite import make_sample, vacuumed

RNG = np.random.default_rng(0)


def png(pixels, kind, bpp, how=0):
    height, width = pixels.shape[:2]
    return I.SIGNATURE + I._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + I._chunk(b"tEXt", b"a\0b") + I._chunk(b"IDAT", zlib.compress(I._filtered(pixels.reshape(height, -1), bpp, how), 1)) + I._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("how", [0, 1, 2, 3, 4, None])
def test_png(kind, n, how):
    for top in (256, 4):
        old = png(RNG.integers(0, top, (23, 31, n)).astype(np.uint8), kind, n, how)
        new = I.encode_png(old)
        assert raw_equal("png", old, new) and b"tEXt" in new and b"tEXt" not in I.encode_png(old, keep_metadata=False)
        assert raw_equal("png", new, I.encode_png(new))


@pytest.mark.parametrize("colours,kind", [(1, 0), (256, 3), (257, 2)])
def test_png_colour_type(colours, kind):
    index = np.r_[np.arange(colours), RNG.integers(0, colours, 4096 - colours)].reshape(64, 64)
    pixels = np.stack([index % 251, index // 251 * 7, index * 3 % 256], axis=2).astype(np.uint8)
    assert I.encode_png(png(pixels, 2, 3))[25] == kind


def test_png_refuses_loss():
    deep = I.SIGNATURE + I._chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0)) + I._chunk(b"IDAT", zlib.compress(b"\0\1\2")) + I._chunk(b"IEND", b"")
    for bad in (deep, b"", b"text", png(np.zeros((4, 4, 3), np.uint8), 2, 3)[:60]):
        with pytest.raises(Exception):
            I.encode_png(bad)
        assert not raw_equal("png", bad, bad)


def test_pnm_tga_bmp_gif():
    for _ in range(60):
        height, width = RNG.integers(1, 30, 2)
        pixels = RNG.integers(0, RNG.integers(1, 4), (height, width, 3)).astype(np.uint8)
        text = b"P3\n# c\n%d %d\n255\n" % (width, height) + b" ".join(b"%d" % v for v in pixels.ravel())
        assert raw_equal("pnm", text, I.encode_pnm(text)) and I.encode_pnm(text)[:2] == b"P6"
        tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 24, 0) + pixels.tobytes()
        assert raw_equal("tga", tga, I.encode_tga(tga))
        body = np.zeros((height, (width + 3) // 4 * 4), np.uint8)
        body[:, :width] = pixels[..., 0]
        palette = RNG.integers(0, 255, (256, 4)).astype(np.uint8).tobytes()
        bmp = b"BM" + struct.pack("<IHHI", 54 + 1024 + body.size, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 0, 0, 256, 0) + palette + body.tobytes()
        assert raw_equal("bmp", bmp, I.encode_bmp(bmp)) and raw_equal("bmp", bmp, I.encode_bmp(I.encode_bmp(bmp)))
        data = bytes(RNG.integers(0, 4, int(RNG.integers(1, 9000))).astype(np.uint8))
        assert I._lzw_decode(I._lzw_encode(data, 2), 2, len(data)) == data
    codes = I._lzw_encode(bytes(100), 2)
    gif = b"GIF89a" + struct.pack("<HHBBB", 10, 10, 0x81, 0, 0) + bytes(12) + b"\x21\xfe\x02hi\0," + struct.pack("<HHHHB", 0, 0, 10, 10, 0) + b"\x02" + bytes((len(codes),)) + codes + b"\0;"
    assert raw_equal("gif", gif, I.encode_gif(gif)) and len(I.encode_gif(gif, False)) < len(gif) and raw_equal("gif", gif, I.encode_gif(gif, False))
    with pytest.raises(I.Unsupported):
        I.encode_pnm(b"P2\n1 1\n65535\n9")


@pytest.mark.parametrize("kind,dtype,encoding", [("i", ">i4", 3), ("f", ">f4", 4), ("d", ">f8", 5)])
def test_mseed(kind, dtype, encoding):
    samples = (RNG.integers(-2000, 2000, 50) if kind == "i" else RNG.normal(size=50)).astype(dtype)
    head = b"000001D %-5s%-2s%-3s%-2s" % (b"STA", b"00", b"BHZ", b"XX") + struct.pack(">HHBBBBHHhhBBBBiHH", 2024, 5, 1, 2, 3, 0, 0, len(samples), 20, 1, 0, 0, 0, 1, 0, 64, 48) + struct.pack(">HHBBBB", 1000, 0, encoding, 1, 9, 0)
    old = (head.ljust(64, b"\0") + samples.tobytes()).ljust(512, b"\0")
    new = mseed.repacked(old)
    assert raw_equal("mseed", old, new) and raw_equal("mseed", new, mseed.repacked(new))
    (seg,) = mseed.segments(new)
    assert seg["sid"] == "XX_STA_00_BHZ" and (seg["samples"] == samples).all()


def test_pdf():
    body = zlib.compress(b"BT hello ET " * 200, 1)
    objects = [b"1 0 obj\n<< /Type /Catalog >>\nendobj\n", b"2 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n", b"3 0 obj\n<< >>\nendobj\n"]
    out, at = b"%PDF-1.4\n", []
    for o in objects:
        at.append(len(out))
        out += o
    table = len(out)
    out += b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % a for a in at) + b"trailer << /Size 4 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table
    new = pdf.recompressed(out)
    assert len(new) < len(out) and raw_equal("pdf", out, new)
    assert all(re.match(rb"\d+ 0 obj", new[int(m[1]) :]) for m in pdf._ROW.finditer(new, new.rfind(b"\nxref")) if m[3] == b"n")
    assert new[int(re.search(rb"startxref\s+(\d+)", new)[1]) :].startswith(b"xref")


MEMBERS = [("b/x2.txt", "file", b"22" * 50, None), ("mimetype", "file", b"application/epub+zip", None), ("a10", "file", b"", None), ("a2", "file", b"q", None)]


@pytest.mark.parametrize("fmt", sorted(C.ZIP_LIKE | C.TAR_LIKE | C.SINGLE | {"a", "cpio"}))
def test_containers(fmt):
    data = C.write_members(MEMBERS, fmt)
    got = C.read_members(data, fmt)
    assert sorted(m[:3] for m in got) == sorted(m[:3] for m in MEMBERS) and data == C.write_members(MEMBERS, fmt)
    if fmt == "epub":
        assert got[0][0] == "mimetype"
    if fmt in C.NATURAL:
        assert [m[0] for m in got][:2] == ["a2", "a10"]
    with pytest.raises(C.Unreadable):
        C.read_members(b"broken" + data[6:20], fmt)


def test_paths_and_bombs():
    assert [C.safe_path(p) for p in ("", "../a", "/a", "a/./b", "a\\b", "a/../../b", "a/../b", "x\0y", "..")] == [None, None, "a", "a/b", "a/b", None, "b", None, None]
    with pytest.raises(C.Unreadable):
        C.read_members(C.write_members([("x", "file", b"0" * 10_000, None)], "zip"), "zip", max_bytes=1000)


def test_covers():
    picture = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 1) + b"d" + struct.pack(">IIIII", 1, 1, 8, 0, 4) + b"DATA"
    flac = b"fLaC" + b"\0" + (34).to_bytes(3, "big") + bytes(34) + b"\x86" + len(picture).to_bytes(3, "big") + picture
    assert C.flac_pictures(flac) == [(3, "image/png", "d", b"DATA")]
    body = b"\0image/png\0\x03d\0DATA"
    mp3 = b"ID3\3\0\0" + bytes((0, 0, 0, len(body) + 10)) + b"APIC" + len(body).to_bytes(4, "big") + b"\0\0" + body
    assert C.id3_pictures(mp3) == [(3, "image/png", "d", b"DATA")]
    atom = lambda name, b: (len(b) + 8).to_bytes(4, "big") + name + b
    mp4 = atom(b"moov", atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", atom(b"covr", atom(b"data", (14).to_bytes(4, "big") + bytes(4) + b"DATA"))))))
    assert C.mp4_covers(mp4) == [(3, "image/png", "", b"DATA")]


def test_sqlite_and_slots():
    old = make_sample(1)
    new = vacuumed(old)
    assert len(new) < len(old) and raw_equal("sqlite", old, new) and not raw_equal("sqlite", old, make_sample(2))
    assert not available("wavpack") and checksum("wavpack", b"") == "" and raw_equal("wavpack", b"x", b"x")
    with pytest.raises(ValueError):
        register_codec("none", lambda d, k: d, lambda d: d)
