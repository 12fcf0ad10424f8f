"""The report as CSV: file rows, container rows, totals."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

# The report's headers.
FILES = ("File", "Container", "MIME", "Before(KB)", "After(KB)", "Delta(%)", "Time(s)", "Result", "Codecs", "Error")
CONTAINERS = ("Container", "Format", "Before(KB)", "After(KB)", "Delta(%)", "Error")
FOOTER = ("Total amount of time", "Encoding mode used")
#: Cells keep their blanks, and quotes are doubled.
_AS_THEY_ARE = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def file_section(results: DataFrame, mode: str) -> DataFrame:
    cells = (
        F.col("path"), F.coalesce("container_origin", F.lit("")), F.col("mime"), scalar.kilobytes(F.col("size_before")), scalar.kilobytes(F.col("size_after")),
        F.format_string("%.2f", scalar.delta_percent(F.col("size_before"), F.col("size_after"), F.col("success"))), F.format_string("%.2f", F.col("seconds")),
        scalar.outcome(F.col("success"), F.col("replaced")), scalar.codec_trail(F.col("codecs_used"), mode), F.coalesce("error_msg", F.lit("")),
    )
    return results.select(*[c.alias(n) for c, n in zip(cells, FILES, strict=True)])


def container_section(containers: DataFrame) -> DataFrame:
    cells = (F.col("filename"), F.col("format"), scalar.kilobytes(F.col("size_before")), scalar.kilobytes(F.col("size_after")), F.format_string("%.2f", scalar.delta_percent(F.col("size_before"), F.col("size_after"), F.col("success"))), F.coalesce("error_msg", F.lit("")))
    return containers.select(*[c.alias(n) for c, n in zip(cells, CONTAINERS, strict=True)])


def write_report(results: DataFrame, containers: DataFrame, path: str, seconds: float, mode: str) -> None:
    """One file with all sections, written row by row in the driver."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(FILES)
        out.writerows(file_section(results, mode).toLocalIterator())
        rows = container_section(containers)
        if not rows.isEmpty():
            out.writerow(())
            out.writerow(CONTAINERS)
            out.writerows(rows.toLocalIterator())
        out.writerow(())
        out.writerow(FOOTER)
        out.writerow((f"{seconds:.2f}", mode))


def write_parts(results: DataFrame, containers: DataFrame, folder: str, mode: str) -> None:
    """The sections as folders of CSV parts, for results of any size."""
    for name, rows in (("files", file_section(results, mode)), ("containers", container_section(containers))):
        rows.write.mode("overwrite").options(header=True, **_AS_THEY_ARE).csv(f"{folder}/{name}")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file rows of such parts, as strings. Null cells have no quotes, empty ones do, and no cell is a NUL."""
    return spark.read.options(header=True, multiLine=True, nullValue="\0", **_AS_THEY_ARE).schema(", ".join(f"`{n}` string" for n in FILES)).csv(f"{folder}/files")


def console_table(results: DataFrame, limit: int = 1000) -> str:
    """The first rows by path as a table of text."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in file_section(results, "pipe").orderBy("File").limit(limit).collect()]
    wide = [max(len(x) for x in col) for col in zip(FILES, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(n) for v, n in zip(row, wide, strict=True)).rstrip() for row in [FILES, *rows])
