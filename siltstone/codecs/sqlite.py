"""SQLite files: vacuum, and equality of their dumps."""

from __future__ import annotations

import hashlib
import os
import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vacuumed(data: bytes) -> bytes:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "db")
        with open(path, "wb") as f:
            f.write(data)
        db = sqlite3.connect(path, isolation_level=None)
        try:
            db.execute("VACUUM")
            db.execute("ANALYZE")
        finally:
            db.close()
        with open(path, "rb") as f:
            return f.read()


def dump_digest(data: bytes) -> str:
    """A digest of the tables' SQL text, without statistics."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        return hashlib.sha256("\n".join(x for x in db.iterdump() if "sqlite_stat" not in x and not x.startswith("ANALYZE")).encode()).hexdigest()
    finally:
        db.close()


def make_sample(seed: int) -> bytes:
    """A database with deleted rows."""
    db = sqlite3.connect(":memory:", isolation_level=None)
    db.execute("create table t (a integer primary key, b text)")
    db.executemany("insert into t values (?, ?)", [(i, f"{seed}-{i}" * 20) for i in range(400)])
    db.execute("delete from t where a % 3 > 0")
    out = db.serialize()
    db.close()
    return out


def sample_database(seed: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: make_sample(int(x)))

    return F.pandas_udf(run, "binary")(seed)


def vacuum(content: Column) -> Column:
    """struct<content, equal>: the vacuumed file, and whether its dump is that of the original."""

    def run(c: pd.Series) -> pd.DataFrame:
        new = c.map(lambda b: vacuumed(bytes(b)))
        return pd.DataFrame({"content": new, "equal": [dump_digest(bytes(a)) == dump_digest(b) for a, b in zip(c, new, strict=True)]})

    return F.pandas_udf(run, "struct<content: binary, equal: boolean>").asNondeterministic()(content)
