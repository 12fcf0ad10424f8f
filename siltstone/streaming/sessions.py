"""Streaming over tables of events and over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_folder, shared_folder


def finished_sessions(spark: SparkSession, folder: str, name: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """user_id, starttime, endtime, n of each session, computed as a stream over the table ``name`` of a folder: one file, or a folder of
    part files. The table is bounded, so every session has ended with it: complete mode emits those still open at the watermark too. The result is a
    table in the shared folder."""
    path = f"{folder}/{name}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    events = (stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", name).parquet(folder)).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    base = shared_folder(spark)
    # each micro-batch replaces the table of sessions, so a batch that runs again changes nothing
    run = sessions.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/sessions")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(sessions.schema).parquet(f"{base}/sessions").select("user_id", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "n")


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path and content of files as they arrive."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
