"""Codecs by processor name: what re-encodes a file's bytes, and what tells whether two files hold the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from ..plans import dims
from . import audio, flac, images, jpeg, mkv, mseed, pdf, sqlite, thorough, tiff, webp


@dataclass(frozen=True)
class Codec:
    """``encode(data, keep_metadata)``; ``canonical(data)`` are bytes that are equal for files of equal content."""

    name: str
    encode: Callable[[bytes, bool], bytes]
    canonical: Callable[[bytes], bytes]


def _raster(decode) -> Callable[[bytes], bytes]:
    def of(data: bytes) -> bytes:
        width, height, pixels = decode(data)
        return b"%d %d " % (width, height) + pixels.tobytes()

    return of


CODECS: dict[str, Codec] = {}
#: What the package itself brings.
BUILT_IN: dict[str, Codec] = {}


def register_codec(name: str, encode: Callable[[bytes, bool], bytes], canonical: Callable[[bytes], bytes]) -> None:
    """Fills or replaces a processor's slot, for the engine's next runs. Processors without a codec are reported as unavailable."""
    if name not in {p[0] for p in dims.PROCESSORS}:
        raise ValueError(f"no processor {name}")
    CODECS[name] = Codec(name, encode, canonical)


register_codec("png", images.encode_png, _raster(images.decode_png))
register_codec("flac", flac.encode, flac.canonical)
register_codec("jpeg", jpeg.encode, jpeg.canonical)
register_codec("zopflipng", thorough.encode_png, _raster(images.decode_png))
register_codec("flexigif", thorough.encode_gif, images.gif_frames)
register_codec("tiff", tiff.encode, tiff.canonical)
register_codec("webp", webp.encode, webp.canonical)
register_codec("mkv", mkv.cleaned, mkv.canonical)
register_codec("ogg", audio.remuxed, audio.ogg_canonical)
register_codec("gif", images.encode_gif, images.gif_frames)
register_codec("tga", images.encode_tga, _raster(images.decode_tga))
register_codec("bmp", images.encode_bmp, _raster(images.decode_bmp))
register_codec("pnm", images.encode_pnm, _raster(images.decode_pnm))
register_codec("sqlite", lambda data, keep: sqlite.vacuumed(data), lambda data: sqlite.dump_digest(data).encode())
register_codec("mseed", mseed.repacked, mseed.canonical)
register_codec("pdf", pdf.recompressed, pdf.canonical)
# placeholders: these files are containers of covers, and stay as they are themselves
for _name in ("mpeg", "wav", "mp4", "aiff"):
    register_codec(_name, lambda data, keep: data, audio.without_pictures)


BUILT_IN.update(CODECS)


def added() -> dict[str, Codec]:
    """Codecs that were registered from outside, which workers don't know by themselves."""
    return {name: codec for name, codec in CODECS.items() if BUILT_IN.get(name) is not codec}


def available(processor: str) -> bool:
    return processor in CODECS


def raw_equal(processor: str, a: bytes, b: bytes, codecs: dict[str, Codec] | None = None) -> bool:
    """Whether both files decode to the same content; what can't be decoded is unequal. Without a codec only equal bytes are equal."""
    codec = (CODECS if codecs is None else codecs).get(processor)
    if codec is None:
        return a == b
    try:
        return codec.canonical(a) == codec.canonical(b)
    except Exception:
        return False


def checksum(processor: str, data: bytes) -> str:
    """A digest of the decoded content, in hex; empty without a codec."""
    codec = CODECS.get(processor)
    return hashlib.sha256(codec.canonical(data)).hexdigest() if codec else ""
