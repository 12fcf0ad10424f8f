"""Choosing among encodings: chained or side by side, then gated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSUPPORTED, NO_GAIN, FAILED = "Unsupported format", "No size improvement", "Pipeline failed"
CORRUPT, INTERRUPTED = "INTEGRITY CHECK FAILED: Data corruption detected", "Interrupted"
NO_ELEMENTS, EXTRACT_FAILED = "Extraction resulted in no elements", "Extraction failed"
TOO_DEEP = "Nested too deeply"


def pipe(value: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """Each step on the result of the one before; an empty or null result ends in null."""
    for step in steps:
        out = step(value)
        value = F.when(F.octet_length(out) > 0, out)
    return value


def pipe_sizes(sizes: Column) -> Column:
    """Fold over an array of result sizes: the last size, or null if any step gave nothing."""
    start = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("ok"))
    end = F.aggregate(sizes, start, lambda a, s: F.struct(s.cast("bigint").alias("size"), (a["ok"] & F.coalesce(s > 0, F.lit(False))).alias("ok")))
    return F.when(end["ok"] & (F.size(sizes) > 0), end["size"])


def best_candidate(candidates: DataFrame, key: str = "path") -> DataFrame:
    """key, size, idx of the smallest successful candidate; ties to the lowest idx; failures only if all failed. A partial aggregate."""
    rank = F.struct((~F.col("success")).alias("failed"), F.col("size").cast("bigint").alias("size"), F.col("idx").alias("idx"))
    best = candidates.groupBy(key).agg(F.min(rank).alias("b"))
    return best.select(key, F.col("b.size").alias("size"), F.col("b.idx").alias("idx"), (~F.col("b.failed")).alias("success"))


def best_of(sizes: list[Column]) -> Column:
    """struct<size, idx> of the smallest non-null size within a row, ties to the lowest index; no shuffle."""
    options = F.array(*[F.struct(s.cast("bigint").alias("size"), F.lit(i).alias("idx")) for i, s in enumerate(sizes)])
    return F.array_min(F.filter(options, lambda o: o["size"].isNotNull()))


def accepted(new: Column, original: Column) -> Column:
    """The size gate: smaller, and not empty."""
    return F.coalesce((new > 0) & (new < original), F.lit(False))


def gate_reason(supported: Column, result: Column, original: Column, verified: Column) -> Column:
    """Why a file was not replaced; null if it was."""
    return (
        F.when(~supported, UNSUPPORTED)
        .when(result.isNull() | (result <= 0), FAILED)
        .when(result >= original, NO_GAIN)
        .when(~verified, CORRUPT)
    )


def extraction_outcome(children: Column, failed: Column, can_recompress: Column) -> Column:
    """What becomes of a container: its expansion, or why there is none."""
    return F.when(~failed & (children > 0), "Extracted").when(can_recompress, NO_ELEMENTS).otherwise(EXTRACT_FAILED)
