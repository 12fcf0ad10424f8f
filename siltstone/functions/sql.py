"""Codecs as functions of SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..codecs import registry


def register(spark: SparkSession) -> None:
    """Registers recompressed(processor, content), raw_equal(processor, a, b) and
    content_checksum(processor, content). Null content gives null; content that can't be re-encoded gives null from recompressed."""

    def recompressed(processor: pd.Series, content: pd.Series) -> pd.Series:
        def one(p, b):
            try:
                return registry.CODECS[p].encode(bytes(b), True)
            except Exception:
                return None

        return pd.Series([None if b is None else one(p, b) for p, b in zip(processor, content, strict=True)])

    def raw_equal(processor: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else registry.raw_equal(p, bytes(x), bytes(y)) for p, x, y in zip(processor, a, b, strict=True)])

    def content_checksum(processor: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else registry.checksum(p, bytes(b)) for p, b in zip(processor, content, strict=True)])

    spark.udf.register("recompressed", F.pandas_udf(recompressed, "binary"))
    spark.udf.register("raw_equal", F.pandas_udf(raw_equal, "boolean"))
    spark.udf.register("content_checksum", F.pandas_udf(content_checksum, "string"))
