"""Report rows, totals and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

#: Least widths of the console table's columns.
FLOORS = {"path": 15, "mime": 12, "result": 12, "before": 10, "after": 10, "delta": 10, "seconds": 5}


def report_rows(results: DataFrame) -> DataFrame:
    """path, mime, before_kb, after_kb, delta_pct, result of each result."""
    size = lambda c: F.col(c).cast("bigint")
    return results.select(
        "path", "mime", scalar.kilobytes(size("size_before")).alias("before_kb"), scalar.kilobytes(size("size_after")).alias("after_kb"),
        scalar.delta_percent(F.col("size_before"), F.col("size_after"), F.col("success")).alias("delta_pct"), scalar.outcome(F.col("success"), F.col("replaced")).alias("result"),
    )


def totals(results: DataFrame) -> DataFrame:
    """One row: n_files, original, saved, reduction_pct. Only replaced files that shrank count as saved."""
    gain = F.when(F.col("replaced") & (F.col("size_before") > F.col("size_after")), F.col("size_before") - F.col("size_after")).otherwise(0)
    t = results.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_before"), F.lit(0)).cast("bigint").alias("original"), F.coalesce(F.sum(gain), F.lit(0)).cast("bigint").alias("saved"))
    return t.withColumn("reduction_pct", F.when(F.col("original") > 0, 100.0 * F.col("saved") / F.nullif(F.col("original"), F.lit(0))).otherwise(0.0))


def widths(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row with the width of each column: the longest value, at least its floor."""
    return rows.agg(*[F.greatest(F.lit(FLOORS[floor]), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(f"{c}_width") for c, floor in columns.items()])


def progress(events: DataFrame, kind: str, scheduled: str, finished: str) -> DataFrame:
    """One row: total and done."""
    return events.agg(F.count_if(F.col(kind) == scheduled).alias("total"), F.count_if(F.col(kind) == finished).alias("done"))
