"""Time series: segments, and equality within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar

#: Relative tolerances by sample type: exact for integers.
TOLERANCE = {"i": 0.0, "f": 1e-6, "d": 1e-9}


def segments(rows: DataFrame, sid: str, ts: str, gap_seconds: float, tie: str) -> DataFrame:
    """Adds seg, counted from 0 within a series: a new one begins after a gap longer than the given one."""
    w = W.partitionBy(sid).orderBy(ts, tie)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    flagged = rows.withColumn("_new", F.when(gap > gap_seconds, 1).otherwise(0))
    return flagged.withColumn("seg", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def summaries(segmented: DataFrame, sid: str, ts: str) -> DataFrame:
    return segmented.groupBy(sid, "seg").agg(F.min(ts).alias("starttime"), F.max(ts).alias("endtime"), F.count("*").alias("samplecnt"))


def equal_within(a: DataFrame, b: DataFrame, sid: str, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """sid, n, equal: whether both sides have the same positions with values within the tolerance."""
    both = a.select(sid, *keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(sid, *keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), [sid, *keys], "full_outer")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~scalar.beyond_tolerance(F.col("_a"), F.col("_b"), tolerance)
    return both.groupBy(sid).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(same, F.lit(False))).alias("equal"))
