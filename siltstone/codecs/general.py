"""General compressors as candidates."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name → (compress, decompress), in order of index.
COMPRESSORS = {
    "zlib": (lambda b: zlib.compress(b, 9), zlib.decompress),
    "bz2": (lambda b: bz2.compress(b, 9), bz2.decompress),
    "xz": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
    "zstd": (lambda b: zstandard.ZstdCompressor(level=19).compress(b), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)),
    "gzip": (lambda b: gzip.compress(b, 9, mtime=0), gzip.decompress),
}


def compressed_sizes(content: Column, codecs: tuple[str, ...] = ("zlib", "bz2", "xz")) -> Column:
    """The size that each codec gives, in an array. Only sizes leave the tasks."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else [len(COMPRESSORS[c][0](bytes(b))) for c in codecs])

    return F.pandas_udf(run, "array<bigint>").asNondeterministic()(content)
