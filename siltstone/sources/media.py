"""What is inside files, as rows: PDF streams, embedded pictures, seismic segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import audio, containers, mseed
from ..functions import scalar

PDF_STREAMS = "path string, obj_id int, decodable boolean, ext string, content binary"
COVERS = "parent string, seq int, mime_type string, description string, picture_type int, content binary"
SEGMENTS = "path string, sid string, seg int, starttime timestamp, samprate double, sampletype string, samplecnt bigint, samples array<double>, text string, error string"


def pdf_streams(files: DataFrame) -> DataFrame:
    """From path and content: one row per stream object, decoded where it can be, with the extension it is given."""

    def run(batches):
        for frame in batches:
            rows = [(path, i, ok, names.get("/Subtype"), names.get("/Filter"), list(names), names.get("/Type"), body) for path, data in zip(frame["path"], frame["content"], strict=True) for i, (names, body, ok) in containers.pdf_streams(bytes(data)).items()]
            yield pd.DataFrame(rows, columns=["path", "obj_id", "decodable", "subtype", "filter", "keys", "kind", "content"])

    rows = files.select("path", "content").mapInPandas(run, "path string, obj_id int, decodable boolean, subtype string, filter string, keys array<string>, kind string, content binary")
    return rows.select("path", "obj_id", "decodable", scalar.pdf_stream_ext(F.col("subtype"), F.col("filter"), F.col("keys"), F.col("kind"), F.col("content")).alias("ext"), "content")


def covers(files: DataFrame) -> DataFrame:
    """From path and content: the pictures in FLAC, MP3, WAV, AIFF, APE, MP4, Vorbis and Opus files, with their size read from their own headers where they are PNG."""

    def run(batches):
        for frame in batches:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                data = bytes(data)
                rows += [(path, i, mime, text, kind, body) for i, (kind, mime, text, body) in enumerate(audio.pictures(data))]
            yield pd.DataFrame(rows, columns=["parent", "seq", "mime_type", "description", "picture_type", "content"])

    rows = files.select("path", "content").mapInPandas(run, COVERS)
    return rows.withColumn("ext", scalar.picture_extension(F.col("mime_type"))).withColumn("size", scalar.png_size(F.col("content")))


def seismic(files: DataFrame) -> DataFrame:
    """From path and content: one row per segment of a series; a file that can't be read gives one row with its error."""

    def run(batches):
        for frame in batches:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    number: dict[str, int] = {}
                    rows = []
                    for s in mseed.segments(bytes(data)):
                        n = number[s["sid"]] = number.get(s["sid"], -1) + 1
                        text = b"".join(s["samples"].tolist()).decode("ascii", "replace") if s["kind"] == "a" else None
                        rows.append((path, s["sid"], n, s["start"].replace(tzinfo=None), s["rate"], s["kind"], len(s["samples"]), None if text is not None else s["samples"].astype(float).tolist(), text, None))
                except Exception as e:
                    rows = [(path, None, None, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")]).astype({"seg": "Int32", "samplecnt": "Int64"})

    return files.select("path", "content").mapInPandas(run, SEGMENTS)
