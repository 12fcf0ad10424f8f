"""File sources: exact listing, filters, bytes on demand."""

from __future__ import annotations

import itertools
import logging
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..session import shared_folder, written

log = logging.getLogger(__name__)
FILES = "path string, length bigint"
#: Entries of a folder that leave a task at once.
LISTED = 10_000


def _valid(patterns: list[str] | None, kind: str) -> list[str]:
    good = []
    for p in patterns or ():
        try:
            re.compile(p)
            good.append(p)
        except re.error as e:
            log.warning("Invalid %s regex: %s (%s)", kind, p, e)
    return good


def path_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Excluded paths go first; with includes, a path must match one. Patterns that don't compile are ignored with a warning;
    if all includes are such, nothing passes."""
    keep = ~scalar.matches_any(path, _valid(exclude, "exclude"))
    return keep & scalar.matches_any(path, _valid(include, "include")) if include else keep


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether it is a folder) of the folders and regular files in a folder, by name. Links to folders are left out, and a folder that
    can't be listed is logged."""
    try:
        with os.scandir(folder) as found:
            for entry in sorted(found, key=lambda e: e.name):
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, 0, True
                elif entry.is_file():
                    yield entry.path, entry.stat().st_size, False
    except OSError as e:
        log.warning("Can't list %s: %s", folder, e)


def _listed(folders: DataFrame) -> DataFrame:
    """The entries of each folder (path), listed by the tasks."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            for folder in frame["path"]:
                entries = _entries(folder)
                while rows := list(itertools.islice(entries, LISTED)):
                    yield pd.DataFrame(rows, columns=["path", "length", "folder"])

    return folders.select("path").mapInPandas(run, f"{FILES}, folder boolean")


def list_files(spark: SparkSession, inputs: list[str], recursive: bool = False) -> DataFrame:
    """path and length of the regular files among the inputs; folders are listed, one level or all. Missing inputs are logged and skipped. Only the
    inputs pass the driver: tasks list folders, level by level, and each level is written."""
    files, folders = [], []
    for given in inputs:
        if os.path.isfile(given):
            files.append((given, os.path.getsize(given)))
        elif os.path.isdir(given):
            folders.append((given,))
        else:
            log.error("Input not found: %s", given)
    out, base, depth = spark.createDataFrame(files, FILES), shared_folder(spark), 0
    level = spark.createDataFrame(folders, "path string") if folders else None
    while level is not None:
        depth, level = depth + 1, written(_listed(level.repartition(spark.sparkContext.defaultParallelism)), f"{base}/{depth}")
        out = out.unionAll(level.where("not folder").select("path", "length"))
        level = level.where("folder")
        if not recursive or level.isEmpty():
            break
    return out


def scan(spark: SparkSession, inputs: list[str], recursive: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path and length of every input file that passes the filters, once each. Folders are listed by ``list_files``, since Spark's own listing drops
    names that start with a dot or an underscore; bytes are read by ``contents``. Standard input is not a path: see ``stdin_files``."""
    if "-" in inputs:
        raise ValueError("standard input must be the only input")
    found = list_files(spark, inputs, recursive)
    return found.where(~scalar.is_junk(F.col("path")) & path_filter(F.col("path"), include, exclude)).distinct()


def scan_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The same for a folder in any store that Spark reads: path and length without the content, which is pruned from the scan.
    Names that start with a dot or an underscore are not seen."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return rows.select("path", "length").where(~scalar.is_junk(F.col("path")))


def stdin_files(spark: SparkSession, data: bytes, name: str = "stdin.bin") -> DataFrame:
    """Standard input as one file, with path and content; its bytes go to the tasks with the row."""
    return spark.createDataFrame([(name, bytearray(data))], "path string, content binary")


def contents(files: DataFrame) -> DataFrame:
    """Adds content, read by the tasks from paths that every worker can open, one file at a time."""

    def read(batches):
        import pandas as pd

        for frame in batches:
            for i in range(len(frame)):
                with open(frame["path"].iloc[i], "rb") as f:
                    yield pd.concat([frame.iloc[[i]].reset_index(drop=True), pd.DataFrame({"content": [f.read()]})], axis=1)

    from pyspark.sql.types import BinaryType, StructField, StructType

    return files.mapInPandas(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))
