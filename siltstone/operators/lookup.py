"""Lookup joins of files with the processor tables. The tables are of fixed size, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans import dims


def by_mime(files: DataFrame) -> DataFrame:
    """One row per file and processor of its content type, with the processor's priority. An empty type matches nothing."""
    return files.where("mime != ''").join(F.broadcast(dims.processor_mimes(files.sparkSession)), "mime")


def by_extension(files: DataFrame) -> DataFrame:
    """One row per file and processor of its extension, whatever its case."""
    table = dims.processor_exts(files.sparkSession).withColumnRenamed("ext", "_ext")
    return files.join(F.broadcast(table), scalar.extension(F.col("path")) == F.col("_ext")).drop("_ext")


def with_fallback(files: DataFrame, name: str = "path") -> DataFrame:
    """Processors by content type; by the extension of ``name`` only for files whose type has none. Left joins of two small arrays, no shuffle."""
    spark = files.sparkSession
    mimes = dims.processors_by_mime(spark).withColumnRenamed("processors", "_by_mime")
    exts = dims.processors_by_ext(spark).select(F.col("ext").alias("_ext"), F.col("processors").alias("_by_ext"))
    joined = files.join(F.broadcast(mimes), "mime", "left").join(F.broadcast(exts), scalar.extension(F.col(name)) == F.col("_ext"), "left")
    found = F.when(F.coalesce(F.size("_by_mime"), F.lit(0)) > 0, F.col("_by_mime")).otherwise(F.col("_by_ext"))
    return joined.withColumn("processors", F.coalesce(found, F.array().cast("array<struct<priority:int,processor:string>>"))).drop("_by_mime", "_by_ext", "_ext")


def supported(files: DataFrame) -> DataFrame:
    """One row per file and processor, after the fallback."""
    return with_fallback(files).select(*files.columns, F.explode("processors").alias("_p")).select(*files.columns, "_p.processor", "_p.priority")


def unsupported(files: DataFrame) -> DataFrame:
    """The files without any processor, with the reason they are skipped."""
    return with_fallback(files).where(F.size("processors") == 0).drop("processors").withColumn("reason", F.lit("Unsupported format"))


def primary(files: DataFrame) -> DataFrame:
    """Each supported file with its first processor in registration order."""
    return with_fallback(files).where(F.size("processors") > 0).withColumn("processor", F.col("processors")[0]["processor"]).drop("processors")


def upsert(results: DataFrame, final: DataFrame, key: str = "path") -> DataFrame:
    """The results with size_after replaced by final_size where there is one."""
    return results.join(final.select(key, "final_size"), key, "left").withColumn("size_after", F.coalesce("final_size", "size_after")).drop("final_size")


def reassociate(members: DataFrame, improved: DataFrame) -> DataFrame:
    """Members (parent_id, seq, content) with their new content where there is one."""
    new = improved.select("parent_id", "seq", F.col("content").alias("_new"))
    return members.join(new, ["parent_id", "seq"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def link_targets(files: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds target, the ``name`` of the first row, by ``order``, among those with equal keys. A partial aggregate and a join back,
    so a group of any size is no single task."""
    first = files.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), F.col(name).alias("_n"))).alias("_f")).select(*keys, F.col("_f._n").alias("target"))
    return files.join(first, keys, "left")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one side has, as often as it has more: none if both are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
