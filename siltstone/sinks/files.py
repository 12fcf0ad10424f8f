"""File sinks: in place, into a folder, or not at all; each file is replaced atomically."""

from __future__ import annotations

import os
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame

RETRIES, WAIT = 10, 0.25


def target(output: str | None, path: str, many: bool) -> str:
    """Where a file goes: in place; into a folder (for several inputs, or if it is one); else to the very path."""
    if not output:
        return path
    return os.path.join(output, os.path.basename(path)) if many or os.path.isdir(output) else output


def replace(data: bytes, path: str) -> None:
    """Writes beside the target, then renames, trying again while the target is held by others. Empty data is refused."""
    if not data:
        raise ValueError("empty output")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(beside, "wb") as f:
            f.write(data)
        for attempt in range(RETRIES):
            try:
                os.replace(beside, path)
                return
            except PermissionError:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(WAIT)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def write_files(improved: DataFrame, output: str | None, many: bool) -> DataFrame:
    """From path and content: path and written. Tasks write, so paths must be in storage that all of them share; a task that is
    run again writes the same bytes."""

    def run(batches):
        for frame in batches:
            done = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                to = target(output, path, many)
                replace(bytes(data), to)
                done.append((path, to))
            yield pd.DataFrame(done, columns=["path", "written"])

    return improved.select("path", "content").mapInPandas(run, "path string, written string")
