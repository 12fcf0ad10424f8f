"""Near-duplicate classes by DartMinHash sketches, banded joining and exact checks.

Texts are weighted sets of five-word shingles. Each gets a sketch (see darts.py), cut into bands; texts that share a band form a
bucket. Exact copies are collapsed first, so only different texts are compared.

All links inside the buckets are found without forming all pairs of a bucket. Each bucket has a centre c, its member with
the most bucket mates, and every member x is compared with it exactly; D(x) is the symmetric difference of x and c. Two members both
linked to c need no comparison. Let y be a member not linked to c. For x to be similar to y, at most (|x| + |y|) / 9 shingles may
differ, while more than (|c| + |y|) / 9 are in D(y); so D(x) and D(y) share more than half of D(x), up to a correction for sizes. Hence any
set of |D(x)| - t + 1 elements of D(x), t being that bound, holds one of D(y): the rarest are looked up among the elements of the unlinked
members' differences, and since both are ordered alike, the bound for the pair's own sizes must hold at the place of the match in each.
In a group of thousands of near copies those are the copies' own edits, and few pairs are left to compare.

Links of classes are then merged by min-label propagation with pointer jumping, in written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fields, forget, quoted, small_batches, text_udf, whole_row, whole_text, written
from .darts import band_keys, shingle_cells, shingle_weights, similarity, sketch

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
PARTS = 64


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t1, t2 (the text's hash) and bands, a key for each band; empty for texts without words."""

    def make():
        def each(texts: list) -> list:
            np.seterr(over="ignore")
            sets = [shingle_weights(t, width) for t in texts]
            owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
            elements, weights = (np.concatenate(x) for x in zip(*sets, strict=True))
            keys = band_keys(sketch(elements, weights, owner, len(sets), bands * rows), bands, rows)
            return [k if len(e) else [] for k, (e, _) in zip(keys, sets, strict=True)]

        return lambda texts: each(texts) if texts else []

    small_batches(docs.sparkSession)
    rows_ = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows_.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), text_udf(make, "array<bigint>")(F.col("text")).alias("bands"))


def _compare(pairs: DataFrame, texts: DataFrame, width: int, threshold: float, with_difference: bool) -> DataFrame:
    """Adds to pairs (a, b): linked, na, nb (sizes) and, if asked for, difference, the cells of only one of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        last, left = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], shingle_cells(ta[i], width)
                right = shingle_cells(tb[i], width)
                linked = similarity(left, right) >= threshold - 1e-12
                out.append((linked, len(left), len(right), np.setxor1d(left, right, assume_unique=True).view(np.int64) if with_difference else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["a", "b", "linked", "na", "nb", "difference"])

    # a centre may have a share of all pairs, so its pairs are dealt to parts, each with a copy of its text
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part"))
    half = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    centres = dealt.select("a", "part").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = half.join(centres, ["a", "part"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, linked boolean, na bigint, nb bigint, difference array<bigint>")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Written rows (bucket, node, n) of the buckets with at least two nodes."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return written(rows.join(shared, "bucket"))


def _stars(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): the centre of a bucket and another member."""
    degrees = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    rows = buckets.join(degrees, "node")
    centres = rows.groupBy("bucket").agg(F.max(F.struct("degree", F.col("node").alias("a"))).alias("m")).select("bucket", "m.a")
    return rows.join(centres, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()


def _others(stars: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of members of one star, not both linked to its centre, that may be similar."""
    share = (1 - threshold) / (1 + threshold)  # of |x| + |y| that may differ at most
    crowds = stars.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("u")).where("n > 1 and u > 0").select("a")
    rows = written(stars.join(crowds, "a").select(F.col("a").alias("c"), "b", "linked", "na", "nb", "difference"))
    common = rows.where("not linked").select("c", F.explode("difference").alias("cell")).groupBy("c", "cell").agg(F.count("*").alias("df"))
    d = F.size("difference")
    bound = F.floor((d - F.greatest(F.lit(0), F.col("nb") - F.col("na")) * share) / 2 - 1e-9) + 1
    own = rows.select("c", "b", "linked", "nb", d.alias("d"), (d - F.greatest(bound, F.lit(1)) + 1).alias("length"), F.explode("difference").alias("cell"))
    ranked = own.join(common, ["c", "cell"], "left").withColumn("r", F.row_number().over(W.partitionBy("c", "b").orderBy(F.coalesce("df", F.lit(0)), "cell")))
    ranked = written(ranked.where("df is not null and (r <= length or not linked)"))
    x = ranked.where("r <= length and (linked or df > 1)").select("c", "cell", F.col("b").alias("x"), F.col("linked").alias("lx"), F.col("nb").alias("nx"), F.col("d").alias("dx"), F.col("r").alias("rx"))
    y = ranked.where("not linked").select(F.col("c").alias("c2"), F.col("cell").alias("cell2"), F.col("b").alias("y"), F.col("nb").alias("ny"), F.col("d").alias("dy"), F.col("r").alias("ry"))
    # of D(x) and D(y) at least so many are common; with one order for both, the first common one then stands early in each
    least = F.greatest(F.lit(1), F.ceil((F.col("dx") + F.col("dy") - (F.col("nx") + F.col("ny")) * share) / 2 - 1e-9))
    early = (F.col("rx") <= F.col("dx") - least + 1) & (F.col("ry") <= F.col("dy") - least + 1)
    sizes = F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold
    # the bounds are symmetric, so two unlinked members need to meet in one order only
    once = F.col("lx") | (F.col("x") < F.col("y"))
    met = x.join(y, (F.col("c") == F.col("c2")) & (F.col("cell") == F.col("cell2")) & (F.col("x") != F.col("y")) & once & sizes & early)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes that edges (a, b) name. Rows with a null have no edge; repeated edges
    count once; without edges there are no nodes."""
    edges = edges.where("a is not null and b is not null")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("heard"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = labels.select("node", "root").join(heard.withColumnRenamed("a", "node"), "node").join(jump, "root", "left")
        new = written(new.select("node", F.col("root").alias("old"), F.least("root", "heard", F.coalesce("far", "root")).alias("root")))
        forget(labels)
        labels = new
        if new.where("old != root").isEmpty():
            forget(both)
            return new


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id and class_id, and the written tables that they are read from."""
    found = written(sketches(docs, id_col, text_col, width, bands, rows))
    named = found.where("doc_id is not null")
    # written, so that joins with it have a shuffle of their own on both sides and Spark can split a text with many copies
    same = written(named.groupBy("t1", "t2").agg(F.min("doc_id").alias("node")))
    heads = written(named.join(same, ["t1", "t2"]).where("doc_id = node").select("node", "bands").distinct())
    buckets = _buckets(heads)
    texts = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    texts = texts.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    spokes = written(_stars(buckets))
    stars = written(_compare(spokes, texts, width, threshold, True))
    pairs = written(_others(stars, threshold))
    more = written(_compare(pairs, texts, width, threshold, False).select("a", "b", "linked"))
    links = stars.where("linked").select("a", "b").union(more.where("linked").select("a", "b"))
    copies = named.join(same, ["t1", "t2"]).select("doc_id", "node")
    # one doc_id with several texts ties their heads together
    least = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    ties = copies.join(least.select("doc_id", "a"), "doc_id").where("node != a").select("a", F.col("node").alias("b")).distinct()
    labels = components(links.union(ties))
    forget(heads, buckets, spokes, stars, pairs, more)
    out = found.select("doc_id", "t1", "t2").join(same, ["t1", "t2"], "left").join(labels.select("node", "root"), "node", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("class_id")), [found, same, labels]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of each row: the least doc_id among the documents that links of at least the threshold join.

    Cases: equal texts are always of one class; null counts as empty. Texts without words are linked to equal texts only; texts of fewer
    words than a shingle are one shingle of all their words. Rows that share a doc_id count as one document, so their texts are of one class. A null
    doc_id has no class (null) and takes no part. Other columns are not read. An empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, width, threshold, bands, rows)[0]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, without near-duplicates: of each class the row of the least doc_id stays,
    once (of several rows with that doc_id the one whose text has the least hash). Rows without doc_id stay. An empty table stays empty."""
    found, tables = _classes(docs, id_col, text_col, width, threshold, bands, rows)
    classes = written(found)
    forget(*tables)
    gone = classes.where("doc_id != class_id").select(F.col("doc_id").alias("key")).distinct()
    kept = docs.select(whole_row(docs), F.col(quoted(id_col)).cast("bigint").alias("key")).join(gone, "key", "left_anti")
    repeated = classes.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("key"))
    if not repeated.isEmpty():
        first = W.partitionBy("key").orderBy(F.xxhash64(F.coalesce(F.col("row").getItem(text_col).cast("string"), F.lit(""))))
        twice = kept.join(repeated, "key", "left_semi").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
        kept = kept.join(repeated, "key", "left_anti").unionByName(twice)
    return kept.select(*fields(docs))
