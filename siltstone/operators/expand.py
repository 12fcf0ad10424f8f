"""Containers and their members: explode, recurse, reassemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, written


def members(rows: DataFrame, container: str, seq: str, value: str) -> DataFrame:
    """container, pos (from 0), member: the members of each container in order."""
    return rows.groupBy(container).agg(F.sort_array(F.collect_list(F.struct(seq, value))).alias("_m")).select(container, F.posexplode("_m").alias("pos", "_e")).select(container, "pos", F.col(f"_e.{value}").alias("member"))


def descend(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node below the roots: root, node, depth. ``edges`` has parent_id and child_id; ``roots`` has node. One join per level, written to the
    shared folder, so that no level is computed again for those below it.
    A node is not reached again through itself, so a cycle ends; a node on several paths occurs once for each. With ``max_depth``, cycles
    are followed and the levels end there."""
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("_path"))
    base, out, depth = shared_folder(roots.sparkSession), level.drop("_path"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(edges, level["node"] == edges["parent_id"])
        if max_depth is None:
            level = level.where(~F.coalesce(F.array_contains("_path", F.col("child_id")), F.lit(False)))
        level = level.select("root", F.col("child_id").alias("node"), F.lit(depth).alias("depth"), F.concat("_path", F.array("child_id")).alias("_path"))
        level = written(level, f"{base}/{depth}")
        if level.isEmpty():
            break
        out = out.unionAll(level.drop("_path"))
    return out


def reassemble(rows: DataFrame, container: str, seq: str, value: str, separator: str) -> DataFrame:
    """container, content, n_members: the members' values in order, joined."""
    ordered = F.sort_array(F.collect_list(F.struct(seq, value)))
    return rows.groupBy(container).agg(F.array_join(F.transform(ordered, lambda m: m[value]), separator).alias("content"), F.count("*").alias("n_members"))
