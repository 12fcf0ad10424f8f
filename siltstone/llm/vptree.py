"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree halves its rows by their distance from a vantage point, down to small leaves, and keeps the range of distances of
each half. A query, knowing its distance d from the vantage point, can be no nearer to a half with range [lo, hi] than
max(d - hi, lo - d); the half is skipped if ``factor`` times that exceeds the distance of the k-th nearest row found so far.
Factor 1 is exact; larger ones skip more.

Shards come from such a tree, too: a top tree, fitted in the driver on at most ``sample_rows`` vectors, deals every row to one of at
most ``TOP_LEAVES`` leaves; a leaf of more than ``shard_rows`` rows, such as one with many equal vectors, is cut into parts
by a hash of the id. Each shard has a tree of its own, and each leaf the ranges of its rows' distances from the vantage points above it.
A query first searches the leaf that it falls into itself; with the distance of the k-th row found there it goes on to those other leaves
that the bound does not rule out.

The index is written once, as a table of (dim, leaf, part, blob, lo, hi) and the top trees. Queries come in blocks, dealt to the shards of
a leaf by an equality join, so neither side is broadcast or gathered.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, setting, shared_folder, written

SHARD_ROWS = 8192
SAMPLE_ROWS = 4096
TOP_LEAVES = 256
TOP_TREES = 16
BLOCK_QUERIES = 1024
LEAF = 48
FACTOR = 1.0


def usable(vector: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, by differences: exact zero for equal vectors."""
    out = np.empty((len(q), len(x)))
    step = max(1, 2_000_000 // max(1, x.size))
    for i in range(0, len(q), step):
        d = q[i : i + step, None, :] - x[None, :, :]
        out[i : i + step] = np.sqrt((d * d).sum(axis=2))
    return out


def _vantage(rng: np.random.Generator, vectors: np.ndarray, rows: np.ndarray) -> int:
    """Of a few rows the one whose distances from others differ most."""
    tries = rows[rng.integers(len(rows), size=4)]
    probe = rows[rng.integers(len(rows), size=64)]
    return int(tries[np.argmax(distances(vectors[tries], vectors[probe]).std(axis=1))])


@dataclass
class Tree:
    """Rows in leaf order; nodes are (vantage row, radius, range in, range out, child in, child out), or (start, end) for a leaf."""

    ids: np.ndarray
    vectors: np.ndarray
    nodes: list[tuple]
    #: How many distances the searches have computed.
    work: int = 0

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5) -> Tree:
        rng, nodes, order = np.random.default_rng(seed), [], []

        def grow(rows: np.ndarray) -> int:
            at = len(nodes)
            nodes.append(())
            if len(rows) <= leaf:
                nodes[at] = (len(order), len(order) + len(rows))
                order.extend(rows.tolist())
                return at
            vantage = _vantage(rng, vectors, rows)
            d = distances(vectors[vantage : vantage + 1], vectors[rows])[0]
            by = np.argsort(d, kind="stable")
            half = len(rows) // 2
            near, far = by[:half], by[half:]
            ranges = (d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
            nodes[at] = (vectors[vantage], *ranges, grow(rows[near]), grow(rows[far]))
            return at

        grow(np.arange(len(ids)))
        place = np.array(order, dtype=np.int64)
        return Tree(ids[place], vectors[place], nodes)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k nearest rows other than those with its own id: distances and ids, filled up with inf and -1. With ``within``,
        only rows up to that distance need to be found."""
        if factor < 1:
            raise ValueError("factor must be at least 1")
        within = np.full(len(queries), np.inf) if within is None else within
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, dtype=np.int64)

        def visit(at: int, q: np.ndarray) -> None:
            if not len(q):
                return
            node = self.nodes[at]
            if len(node) == 2:
                a, b = node
                self.work += len(q) * (b - a)
                d = distances(queries[q], self.vectors[a:b])
                d[own[q][:, None] == self.ids[None, a:b]] = np.inf
                both = np.concatenate([best[q], d], axis=1)
                ids = np.concatenate([found[q], np.broadcast_to(self.ids[a:b], d.shape)], axis=1)
                first = np.lexsort((ids, both), axis=1)[:, :k]
                best[q], found[q] = np.take_along_axis(both, first, 1), np.take_along_axis(ids, first, 1)
                return
            vantage, lo_in, hi_in, lo_out, hi_out, inner, outer = node
            self.work += len(q)
            d = distances(queries[q], vantage[None, :])[:, 0]
            near = d <= (hi_in + lo_out) / 2
            least = {inner: np.maximum(d - hi_in, lo_in - d), outer: np.maximum(d - hi_out, lo_out - d)}
            for child, some in ((inner, near), (outer, ~near), (outer, near), (inner, ~near)):
                rows = q[some]
                visit(child, rows[_reached(least[child][some], np.minimum(best[rows, k - 1], within[rows]), factor)])

        visit(0, np.arange(len(queries)))
        found[np.isinf(best)] = -1
        return best, found


def _reached(least: np.ndarray, nearest: np.ndarray, factor: float) -> np.ndarray:
    """Whether something at least so far away may still count, with room for rounding."""
    return least * factor <= nearest * (1 + 1e-12) + 1e-12


@dataclass
class Top:
    """The tree above the shards. Nodes are (radius, child in, child out) with a row of ``vantages``, or a leaf's number; ``paths`` has the
    nodes above each leaf. A leaf knows the ranges of its rows' distances from those: ``lo`` and ``hi``."""

    vantages: np.ndarray
    nodes: list[tuple | int]
    paths: list[list[int]]
    lo: dict[int, np.ndarray] = field(default_factory=dict)
    hi: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fit(vectors: np.ndarray, depth: int, seed: int = 6) -> Top:
        rng, nodes, paths, vantages = np.random.default_rng(seed), [], [], []

        def grow(rows: np.ndarray, path: list[int], depth: int) -> int:
            at = len(nodes)
            nodes.append(len(paths))
            vantages.append(np.zeros(vectors.shape[1]))
            d = None
            if depth and len(rows) > 1:
                vantages[at] = vectors[_vantage(rng, vectors, rows)]
                d = distances(vantages[at][None, :], vectors[rows])[0]
            if d is None or d.min() == d.max():
                paths.append(path)
                return at
            radius = np.median(d)
            if radius == d.max():  # many equal vectors: those stay together
                radius = d[d < radius].max()
            below = [*path, at]
            nodes[at] = (radius, grow(rows[d <= radius], below, depth - 1), grow(rows[d > radius], below, depth - 1))
            return at

        grow(np.arange(len(vectors)), [], depth)
        return Top(np.array(vantages).reshape(len(nodes), vectors.shape[1]), nodes, paths)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        leaf = np.zeros(len(vectors), np.int64)

        def visit(at: int, rows: np.ndarray) -> None:
            node = self.nodes[at]
            if isinstance(node, int):
                leaf[rows] = node
            elif len(rows):
                near = distances(vectors[rows], self.vantages[at][None, :])[:, 0] <= node[0]
                visit(node[1], rows[near])
                visit(node[2], rows[~near])

        visit(0, np.arange(len(vectors)))
        return leaf

    def ranges(self, leaf: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(vectors, self.vantages[self.paths[leaf]])
        return d.min(axis=0), d.max(axis=0)

    def others(self, queries: np.ndarray, home: np.ndarray, nearest: np.ndarray, factor: float) -> list[np.ndarray]:
        """For each leaf that has rows: which queries, not at home there, may find something nearer than ``nearest`` in it."""
        d = distances(queries, self.vantages)
        out = []
        for leaf in sorted(self.lo):
            far = d[:, self.paths[leaf]]
            least = np.maximum(far - self.hi[leaf], self.lo[leaf] - far).max(axis=1, initial=0.0)
            out.append((leaf, np.flatnonzero((home != leaf) & _reached(least, nearest, factor))))
        return out


@dataclass
class Index:
    """The written index: its shards, and the top tree of each length of vectors that has one."""

    shards: DataFrame
    tops: dict[int, Top]


def _stacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, each id once (the least vector, if rows with one id differ)."""
    ids, vectors = frame["vec_id"].to_numpy(np.int64), np.array(frame["v"].tolist(), dtype=np.float64)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    once = np.r_[True, ids[1:] != ids[:-1]]
    return ids[once], vectors[once]


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v, dim of the usable rows, each id once."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    repeated = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if not repeated.isEmpty():
        once = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(once.select("vec_id", "v"))
    return rows.withColumn("dim", F.size("v"))


def _routed(rows: DataFrame, tops: dict[int, Top]) -> DataFrame:
    """Adds leaf, 0 for lengths without a top tree."""
    if not tops:
        return rows.withColumn("leaf", F.lit(0))

    def run(batches):
        for frame in batches:
            leaf = np.zeros(len(frame), np.int32)
            for dim, top in tops.items():
                mine = np.flatnonzero(frame["dim"] == dim)
                if len(mine):
                    leaf[mine] = top.route(np.array(frame["v"].iloc[mine].tolist(), np.float64))
            yield frame.assign(leaf=leaf)

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("vec_id", "v", "dim").mapInPandas(run, f"vec_id bigint, v {kind}, dim int, leaf int")


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> Index:
    """An index of every usable vector. Rows without id take no part; of rows with one id the least vector counts.

    Top trees are fitted on at most about ``sample_rows`` vectors of each length that has more than ``shard_rows`` rows (of the TOP_TREES
    most frequent lengths; others make one leaf). They only decide which rows lie together: all rows are indexed.
    """
    path = path or shared_folder(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(TOP_TREES).collect()}
    tops = {}
    for dim, n in sizes.items():
        sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // sample_rows))) == 0)).select("vec_id", "v")
        sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
        leaves = min(TOP_LEAVES, -(-n // shard_rows), max(1, len(sample) // 16))
        tops[dim] = Top.fit(np.array(sample["v"].tolist(), np.float64), (leaves - 1).bit_length())
    routed = written(_routed(rows, tops), f"{path}/routed")
    counts = routed.groupBy("dim", "leaf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).alias("parts"))
    dealt = routed.join(counts, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        dim, leaf = int(frame["dim"].iloc[0]), int(frame["leaf"].iloc[0])
        tree = Tree.build(*_stacked(frame))
        lo, hi = tops[dim].ranges(leaf, tree.vectors) if dim in tops else (np.zeros(0), np.zeros(0))
        blob = pickle.dumps((tree.ids, tree.vectors.astype(frame["v"].iloc[0].dtype), tree.nodes), protocol=5)
        return pd.DataFrame({"dim": [dim], "leaf": [leaf], "part": [frame["part"].iloc[0]], "blob": [blob], "lo": [lo], "hi": [hi]})

    shards = written(dealt.select("dim", "leaf", "part", "vec_id", "v").groupBy("dim", "leaf", "part").applyInPandas(grow, "dim int, leaf int, part int, blob binary, lo array<double>, hi array<double>"), f"{path}/shards")
    # ranges of leaves over their parts: at most TOP_TREES * TOP_LEAVES rows
    places = shards.select("dim", "leaf", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "r")).groupBy("dim", "leaf", "i").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
    for r in places.groupBy("dim", "leaf").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("x")).collect():
        tops[r.dim].lo[r.leaf], tops[r.dim].hi[r.leaf] = np.array([x.lo for x in r.x]), np.array([x.hi for x in r.x])
    return Index(shards, tops)


def _blocks(rows: DataFrame, block_queries: int) -> DataFrame:
    """dim, leaf, queries: rows (dim, leaf, vec_id, v, within) gathered to blocks."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = _stacked(frame)
        within = frame.set_index("vec_id")["within"].groupby(level=0).first().loc[ids].to_numpy(np.float64)
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "leaf": [frame["leaf"].iloc[0]], "queries": [pickle.dumps((ids, vectors, within), protocol=5)]})

    sizes = rows.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block_queries).alias("blocks"))
    dealt = rows.join(sizes, ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("dim", "leaf", "block").applyInPandas(gather, "dim int, leaf int, queries binary")


def _hits(index: Index, blocks: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score: what each shard of a block's leaf finds."""

    def look(batches):
        for frame in batches:
            for blob, block in zip(frame["blob"], frame["queries"], strict=True):
                ids, stored, nodes = pickle.loads(blob)
                own, asked, within = pickle.loads(block)
                d, found = Tree(ids, stored.astype(np.float64), nodes).search(asked, own, k, factor, within)
                some = (found >= 0) | np.isfinite(d)
                yield pd.DataFrame({"query_id": np.repeat(own, k)[some.ravel()], "vec_id": found.ravel()[some.ravel()], "score": d.ravel()[some.ravel()]})

    met = blocks.join(index.shards.select("dim", "leaf", "part", "blob"), ["dim", "leaf"])
    return met.select("blob", "queries").mapInPandas(look, "query_id bigint, vec_id bigint, score double")


def search(index: Index, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, nearest first, ties to the smaller vec_id.

    Cases: a vector that is null, empty or zero, or holds null or non-finite components, takes no part on either side; vectors of
    different length never meet. Rows with one vec_id count once, and a query doesn't find its own id. With fewer than k
    candidates all are returned. Other columns are not read. Empty tables give an empty result.
    """
    tops, spark = index.tops, queries.sparkSession
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    asked = written(_routed(_rows(queries, id_col, vector_col), tops))
    # a shard and a block are a few MB together, so few go into a batch
    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="8"):
        hits = written(_hits(index, _blocks(asked.withColumn("within", F.lit(float("inf"))), block_queries), k, factor))
        if any(len(t.lo) > 1 for t in tops.values()):
            first = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            reach = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("within"))
            known = asked.join(reach.select(F.col("query_id").alias("vec_id"), "within"), "vec_id", "left").fillna(float("inf"), ["within"])

            def go_on(batches):
                for frame in batches:
                    for dim, top in tops.items():
                        mine = frame[frame["dim"] == dim]
                        if len(mine):
                            vectors = np.array(mine["v"].tolist(), np.float64)
                            for leaf, rows in top.others(vectors, mine["leaf"].to_numpy(), mine["within"].to_numpy(np.float64), factor):
                                yield mine.iloc[rows].assign(leaf=np.int32(leaf))

            kind = asked.schema["v"].dataType.simpleString()
            with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1024"):
                further = written(known.select("vec_id", "v", "dim", "leaf", "within").mapInPandas(go_on, f"vec_id bigint, v {kind}, dim int, leaf int, within double"))
            hits = hits.union(written(_hits(index, _blocks(further, block_queries), k, factor)))
            forget(further)
    forget(asked)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
