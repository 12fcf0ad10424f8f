"""Statistics of pixels, by which an image's colour type is narrowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

PALETTE = 256


def colour_stats(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Per image: n_pixels, all_gray, all_opaque, n_colours (exact), and the narrowest colour type that keeps every pixel."""
    stats = pixels.groupBy(image).agg(
        F.count("*").alias("n_pixels"),
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("all_gray"),
        F.bool_and(F.col("a") == 255).alias("all_opaque"),
        F.countDistinct(scalar.pack_rgba(F.col("r"), F.col("g"), F.col("b"), F.col("a"))).alias("n_colours"),
    )
    return stats.withColumn("colour_type", colour_type(F.col("n_colours"), F.col("all_gray"), F.col("all_opaque")))


def colour_type(colours: Column, gray: Column, opaque: Column) -> Column:
    return F.when(colours <= PALETTE, "palette").when(gray & opaque, "gray").when(gray, "gray_alpha").when(opaque, "rgb").otherwise("rgba")
