"""Codecs that hold sound, pages, codes and containers: what goes in comes out."""

import numpy as np
import pytest

from siltstone.codecs import audio, flac, images, iso, jpeg, mkv, pdf, samples, thorough, tiff, webp
from siltstone.codecs.containers import pdf_streams, read_members
from siltstone.codecs.registry import CODECS, raw_equal


@pytest.mark.parametrize("n,channels,bits", [(1, 1, 8), (5000, 1, 16), (9000, 2, 16), (4096, 2, 24), (17, 3, 8), (0, 2, 16), (300, 2, 32)])
def test_flac(n, channels, bits):
    rng, t = np.random.default_rng(1), np.arange(n)
    x = np.stack([(np.sin(t / 20 + c) * (1 << bits - 3)).astype(np.int64) + rng.integers(-3, 4, n) for c in range(channels)], axis=1)
    data = flac.write(flac.Sound(44100, bits, x, [(4, b"tags"), (1, bytes(500))]))
    back = flac.decode(data)
    assert (back.samples == x).all() and back.samples.shape == x.shape and (back.rate, back.bits) == (44100, bits)
    assert back.digest == flac.digest(x, bits) and back.blocks[0] == (4, b"tags")
    small = flac.encode(data)
    assert len(small) < len(data) and raw_equal("flac", data, small) and flac.decode(flac.encode(data, False)).blocks == []


def test_flac_odd_signals():
    rng = np.random.default_rng(2)
    for x, bits in ((rng.integers(-1 << 15, 1 << 15, (5000, 2)), 16), (np.full((5000, 1), 7), 16), ((1 << 20) * rng.integers(-9, 9, (5000, 1)), 32)):
        assert (flac.decode(flac.write(flac.Sound(8000, bits, x.astype(np.int64), []))).samples == x).all()
    good = flac.write(flac.Sound(8000, 16, rng.integers(-99, 99, (500, 1)), []))
    for bad in (b"", good[:60], good[:-9], good[:80] + bytes((good[80] ^ 1,)) + good[81:]):
        assert not raw_equal("flac", good, bad)


def test_tiff():
    rng = np.random.default_rng(0)
    px = rng.integers(0, 3, (20, 30, 4)).astype(np.uint8)
    opaque = np.dstack([px[..., :3], np.full((20, 30), 255, np.uint8)])
    for first in (px, opaque, np.dstack([px[..., :1]] * 3 + [opaque[..., 3]])):
        data = tiff.write([((30, 20, first), {}, "<"), ((30, 20, px), {}, "<")])
        pages = tiff.decode(data)
        assert (pages[0][2] == first).all() and (pages[1][2] == px).all() and raw_equal("tiff", data, tiff.encode(data))
    plain = samples.image("tiff", opaque[..., :3])
    assert len(tiff.encode(plain)) < len(plain) and raw_equal("tiff", plain, tiff.encode(plain)) and not raw_equal("tiff", plain, data)
    assert tiff._packbits(b"\x02abc\xfex\x80\x00z") == b"abcxxxz"
    # clear, 1, 2, then the entry of both, end: nine bits each
    assert tiff._lzw(int("".join(f"{c:09b}" for c in (256, 1, 2, 258, 257)).ljust(48, "0"), 2).to_bytes(6, "big")) == b"\1\2\1\2"


@pytest.mark.parametrize("least", [2, 4, 8])
def test_gif_codes(least):
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 100, 5000):
        for data in (rng.integers(0, 1 << least, n), np.repeat(rng.integers(0, 1 << least, n // 9 + 1), 9)):
            raw = bytes(data.astype(np.uint8))
            codes = thorough.lzw(raw, least)
            assert images._lzw_decode(codes, least, len(raw)) == raw and len(codes) <= len(images._lzw_encode(raw, least)) + 1


@pytest.mark.parametrize("shape", [(64, 48, 1, 0), (70, 33, 3, 0), (70, 33, 3, 2)])
def test_jpeg_tables(shape):
    width, height, components, interval = shape
    data = samples.jpeg_file(width, height, 0, components, interval)
    small = jpeg.encode(data)
    assert len(small) < 0.8 * len(data) and jpeg.scan(small)[2] == jpeg.scan(data)[2] and raw_equal("jpeg", data, small)
    assert not raw_equal("jpeg", data, samples.jpeg_file(width, height, 1, components, interval))


def test_iso():
    files = [("a.txt", "file", b"hello"), ("dir", "dir", None), ("dir/ünï.bin", "file", b"x" * 5000), ("dir/sub/deep", "file", b""), *((f"f{i}", "file", b"%d" % i) for i in range(100))]
    back = read_members(iso.write(files), "iso")
    assert sorted(m[:3] for m in back if m[1] == "file") == sorted(f for f in files if f[1] == "file")
    with pytest.raises(images.Unsupported):
        iso.members(bytes(40_000))


@pytest.mark.parametrize("kind", samples.SOUNDS)
def test_covers(kind):
    old, new = b"\x89PNG" + b"x" * 70_000, b"\x89PNG small"
    data = samples.sound(kind, old)
    assert [p[3] for p in audio.pictures(data)] == [old]
    out = audio.with_pictures(data, [new])
    assert [p[3] for p in audio.pictures(out)] == [new] and audio.pictures(out)[0][:3] == audio.pictures(data)[0][:3]
    assert audio.without_pictures(out) == audio.without_pictures(data) and len(out) < len(data) - 60_000
    if kind == "mp4":
        at = out.index(b"stco")
        assert out[int.from_bytes(out[at + 12 : at + 16], "big") :][:8] == b"SAMPLES!"
    with pytest.raises(images.Unsupported):
        audio.with_pictures(data, [])


def test_ogg_pages():
    data = samples.sound("ogg", b"\x89PNG" + b"x" * 200_000)
    small = audio.remuxed(data)
    assert len(small) < len(data) and raw_equal("ogg", data, small) and audio.remuxed(small) == small
    assert not raw_equal("ogg", data, samples.sound("ogg", b"\x89PNG"))


def test_pdf_equality_sees_what_is_outside_streams():
    data = samples.pdf_file(b"text " * 500)
    small = pdf.recompressed(data)
    assert len(small) < len(data) and raw_equal("pdf", data, small)
    assert not raw_equal("pdf", data, small.replace(b"/Count 1", b"/Count 2"))


@pytest.mark.parametrize("predicted", [False, True])
def test_pdf_reference_streams(predicted):
    data = samples.pdf_with_references(b"text and more text " * 500, predicted)
    small = pdf.recompressed(data)
    assert len(small) < len(data) and raw_equal("pdf", data, small) and pdf_streams(small)[4][1] == b"text and more text " * 500
    rows = np.frombuffer(pdf_streams(small)[6][1], np.uint8).reshape(7, 6)
    for number, (kind, *place, _) in enumerate(rows.tolist()):
        assert kind != 1 or small[int.from_bytes(bytes(place), "big") :].startswith(b"%d 0 obj" % number)
    start = int(small[small.index(b"startxref") + 10 :].split()[0])
    assert small[start:].startswith(b"6 0 obj")
    # wrong places, other objects, other text
    assert not raw_equal("pdf", data, small.replace(b"startxref\n", b"startxref\n1")) and not raw_equal("pdf", data, small.replace(b"/Size 7", b"/Size 8"))
    assert not raw_equal("pdf", data, samples.pdf_with_references(b"other", predicted))
    with pytest.raises(images.Unsupported):
        pdf.recompressed(data.replace(b"/W [1 4 1]", b"/W [1 4 2]"))
    assert not raw_equal("pdf", samples.pdf_file(b"a" * 99), samples.pdf_file(b"a" * 99).replace(b"0000000009", b"0000000010"))


@pytest.mark.parametrize("kind", ["png", "zopflipng", "gif", "flexigif", "tga", "bmp", "pnm", "tiff", "webp"])
def test_sample_images(kind):
    pixels = np.random.default_rng(1).integers(0, 9, (8, 8, 1)).astype(np.uint8).repeat(3, axis=2)
    data = samples.image(kind, pixels)
    assert raw_equal(kind, data, CODECS[kind].encode(data, True)) and not raw_equal(kind, data, samples.image(kind, pixels + 1))


def test_matroska():
    data = samples.video(b"frame" * 100)
    small = mkv.cleaned(data)
    assert len(small) < len(data) - 150 and raw_equal("mkv", data, small) and mkv.cleaned(small) == small
    # the cue and the seek entry lead to the cluster
    _, children, base, _ = mkv._segment(small)
    place = next(start - base for kind, start, _, _ in children if kind == mkv.CLUSTER)
    assert [int.from_bytes(small[small.index(head) + len(head) :][:4], "big") for head in (b"\x53\xac\x84", b"\xf7\x81\x01\xf1\x84")] == [place, place]
    assert not raw_equal("mkv", data, samples.video(b"other")) and not raw_equal("mkv", data, data[:-3])
    with pytest.raises(images.Unsupported):
        mkv.cleaned(data.replace(b"\x53\xac\x84", b"\x53\xac\x84\x01", 1)[: len(data)])


def test_flac_digest_is_held():
    good = flac.write(flac.Sound(8000, 16, np.arange(100)[:, None], []))
    with pytest.raises(images.Unsupported):
        flac.decode(good[:26] + bytes(15) + b"x" + good[42:])


def _webp_cases():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:60, :75]
    slope = np.dstack([x + y, x * 2, y * y // 30, np.full_like(x, 255)]).astype(np.uint8)
    yield from (slope, (slope + rng.integers(0, 5, slope.shape)).astype(np.uint8), rng.integers(0, 256, (9, 7, 4)).astype(np.uint8))
    for colors, shape in ((2, (33, 50)), (3, (40, 1)), (9, (1, 40)), (200, (20, 20))):  # two, four, sixteen and more places in a palette
        yield rng.integers(0, 256, (colors, 4)).astype(np.uint8)[rng.integers(0, colors, shape)]
    yield from (np.zeros((1, 1, 4), np.uint8), np.zeros((90, 90, 4), np.uint8))


@pytest.mark.parametrize("i", range(9))
def test_webp(i):
    pixels = list(_webp_cases())[i]
    data = webp.plain(pixels)
    small = webp.encode(data)
    for out in (data, small):
        assert webp.decode(out)[:2] == pixels.shape[1::-1] and (webp.decode(out)[2] == pixels).all()
    image = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    assert (webp._lossless(webp._with_predictors(image)) == image).all() and len(small) <= len(data) and raw_equal("webp", data, small)


def test_webp_files_of_others():
    """A picture whose alpha another library wrote as a lossless stream, beside the same picture as PNG; and the smallest lossless file."""
    import base64
    from pathlib import Path

    tiny = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(tiny)[2].tolist() == [[[0, 0, 0, 0]]]
    test = pytest.importorskip("test")
    folder = Path(test.__file__).parent / "test_email" / "data"
    if not (folder / "python.webp").exists():
        pytest.skip("no sample files")
    assert (webp.alpha((folder / "python.webp").read_bytes()) == images.decode_png((folder / "python.png").read_bytes())[2][..., 3]).all()


def test_webp_chunks():
    pixels = np.full((5, 6, 4), 9, np.uint8)
    body = dict(webp.chunks(webp.plain(pixels)))[b"VP8L"]
    head = bytes((webp.ALPHA | webp.EXIF, 0, 0, 0, 5, 0, 0, 4, 0, 0))
    data = webp._file([(b"VP8X", head), (b"VP8L", body), (b"EXIF", b"camera")])
    kept, bare = webp.encode(data), webp.encode(data, False)
    assert b"camera" in kept and b"camera" not in bare and dict(webp.chunks(bare))[b"VP8X"][0] == webp.ALPHA
    assert raw_equal("webp", data, kept) and raw_equal("webp", data, bare)
    lossy = webp._file([(b"VP8X", head), (b"ALPH", b"a"), (b"VP8 ", b"coded"), (b"XMP ", b"x" * 9)])
    assert webp.encode(lossy) == lossy and raw_equal("webp", lossy, webp.encode(lossy, False)) and len(webp.encode(lossy, False)) < len(lossy)
    assert not raw_equal("webp", lossy, lossy.replace(b"coded", b"other"))
    for bad in (b"", data[:-9], data[:40], webp._file([(b"ANIM", b""), (b"VP8L", body)]), webp._file([(b"VP8L", body[:7])])):
        assert not raw_equal("webp", data, bad)
    with pytest.raises(images.Unsupported):
        webp.encode(webp._file([(b"ANMF", body)]))
