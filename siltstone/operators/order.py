"""Orders inside groups, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..session import shared_folder, written


def ranked(rows: DataFrame, group: Column, keys: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row in the order of the keys within its group, from 1. Rows are dealt by ranges of group and keys, so a group with a
    third of all rows is shared by many tasks; each range is numbered by itself and moved by the rows of its group in the ranges before."""
    spark = rows.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", group.alias("_g"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    # written, so that a row's range is the same for both uses
    placed = written(keyed.repartitionByRange("_g", *names).withColumn("_p", F.spark_partition_id()), shared_folder(spark))
    own = F.row_number().over(W.partitionBy("_p", "_g").orderBy(*names))
    sizes = placed.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_g").alias("_g2"), F.col("_p").alias("_p2"), before.alias("_before"))
    joined = placed.withColumn("_own", own).join(starts, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_p") == F.col("_p2")))
    return joined.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias(out))


def natural_rank(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Adds rank, the place in natural order within the group."""
    key = scalar.natural_key(F.col(name))
    return ranked(rows, F.col(group), [key["key"], key["length"], key["path"]])


def path_rank(rows: DataFrame, path: str, *ties: str) -> DataFrame:
    """Adds rank, the place by path over all rows."""
    return ranked(rows, F.lit(0), [F.col(path), *map(F.col, ties)])


def special_first(rows: DataFrame, group: str, special: Column, seq: str) -> DataFrame:
    """Adds place: special members come first, then all in their order."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.when(special, 0).otherwise(1), seq)))


def lifo(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """Adds pop: 1 for what was pushed last."""
    return rows.withColumn("pop", F.row_number().over(W.partitionBy(group).orderBy(F.desc(seq))))


def adjacent_unique(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Without the rows whose value equals the one before, in order within the group."""
    before = F.lag(value).over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def dictionary(rows: DataFrame, value: str, position: str) -> DataFrame:
    """value, first_position, idx (from 0) by first appearance. Distinct values are few (a palette), so one task ranks them."""
    first = rows.groupBy(value).agg(F.min(position).alias("first_position"))
    return first.withColumn("idx", F.row_number().over(W.orderBy("first_position")) - 1)
