"""What the operators of this subpackage share: reading, text UDFs and written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, setting, shared_folder

__all__ = ["fields", "forget", "quoted", "removed", "setting", "shared_folder", "small_batches", "table", "text_udf", "whole_row", "whole_text", "written"]

#: Rows in an Arrow batch. Texts can be long, so batches are kept small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """For the rest of the session, since what an operator returns runs only when its caller wants the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns of a table as one struct, row, so that no name of theirs can clash with a working column."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")


def fields(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct row, in order, those that are named with new values."""
    return [changed.get(c, F.col("row").getItem(c)).alias(c) for c in docs.columns]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: lineage ends here and outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for t in tables:
        removed(t.sparkSession, t._written_at)


def text_udf(make: Callable[[], Callable[[list], list]], returns) -> Callable[[Column], Column]:
    """An Arrow UDF over one column. ``make`` runs once in a task and returns a function from a batch's
    values to a list of results. Marked non-deterministic so that the optimizer never evaluates it twice."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            yield pa.array(each(batch.to_pylist()), type=arrow_kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()
