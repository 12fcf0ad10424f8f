"""Line deduplication over levelled sorted runs of line hashes.

A run is a bucketed table (h1, h2, n): the 128-bit hash of a line's key and the number of documents that hold it, one row per
key, dealt to buckets by the hash and sorted in each. A new batch of documents is counted, merge-anti-joined with the keys that the
runs have settled (those of at least ``min_docs`` documents), takes over the counts that the runs have of its other keys, and
becomes a run of level 0 itself. When a level has ``fanout`` runs they are merged into one run of the next level, so there are few
runs at any time and each key is rewritten a logarithmic number of times. Runs and batches have one bucketing, so these joins
neither shuffle nor sort. A line is dropped if its key is settled after the last batch.

Texts are shuffled once, to meet the positions of their dropped lines; all else moves hashes only. Exact copies of a text share
one list of positions. A line in a third of all documents is pre-aggregated within each task before it is counted, then settled by the first
batch; on the way back to its lines it meets them in an equality join, whose large partitions Spark splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, setting, shared_folder, whole_row, whole_text, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES = 5
FANOUT = 2
MIN_DOCS = 10
#: Scans of a bucketed table with one file for each bucket are sorted; Spark looks for that only if told.
SORTED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed(value: Column, first: str, second: str) -> list[Column]:
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(1), value).alias(second)]


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has at first."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


class LineRuns:
    """A levelled store of sorted runs in a shared folder, for one threshold.

    Rows are (h1, h2, n), one for each key of a run. n is the number of documents with that key in all batches up to the run's own, so the
    entry of the newest run counts. A key with ``min_docs`` documents is settled: later batches drop it by an anti-join, so it has one entry.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.fanout, self.min_docs = spark, path or shared_folder(spark), fanout, min_docs
        self.buckets = partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        """A run from rows that are dealt by the hash of h1 and h2 already: one sorted file for each bucket."""
        name = f"siltstone_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        removed(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def met(self, batch: DataFrame) -> DataFrame:
        """A batch (h1, h2, n), bucketed like the runs, after meeting them all: without the settled keys, and with the documents
        counted before. Both sides of each merge join are sorted by bucket, so nothing is shuffled or sorted."""
        batch = batch.select("h1", "h2", "n", F.lit(0).cast("bigint").alias("before"))
        for run in self.runs():
            batch = batch.join(run.where(F.col("n") >= self.min_docs).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            older = run.where(F.col("n") < self.min_docs).select("h1", "h2", F.col("n").alias("m"))
            batch = batch.join(older.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", "n", F.greatest("before", "m").alias("before"))
        return batch.select("h1", "h2", (F.col("n") + F.col("before")).alias("n"))

    def _take(self, batch: DataFrame) -> None:
        with setting(self.spark, **SORTED):
            self.levels = self.levels or [[]]
            self.levels[0].append(self._write(self.met(batch)))
            level = 0
            while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._compacted(old))
                level += 1

    def _compacted(self, names: list[str]) -> str:
        """One run of several, by merging two at a time."""
        whole = names[0]
        for name in names[1:]:
            newer = self.spark.table(name).select("h1", "h2", F.col("n").alias("m"))
            merged = self._write(self.spark.table(whole).join(newer.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", F.greatest("n", "m").alias("n")))
            self._drop(whole)
            self._drop(name)
            whole = merged
        return whole

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: rows (h1, h2), one for each document and key."""
        self.add_all(keys.select(F.lit(0).alias("batch"), "h1", "h2"), 1)

    def add_all(self, keys: DataFrame, batches: int) -> None:
        """Adds batches one after another. Rows (batch, h1, h2), batches numbered from 0, are counted and bucketed in one pass over the
        input; then each batch meets the runs before its own run joins them."""
        counts = [F.count_if(F.col("batch") == b).alias(f"n{b}") for b in range(batches)]
        staged = self._write(keys.groupBy("h1", "h2").agg(*counts))
        for b in range(batches):
            self._take(self.spark.table(staged).where(f"n{b} > 0").select("h1", "h2", F.col(f"n{b}").alias("n")))
        self._drop(staged)

    def frequent(self) -> DataFrame:
        """h1, h2 of the settled keys, each once."""
        out = self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        for run in self.runs():
            out = out.union(run.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        return out

    def drop(self) -> None:
        """Deletes all runs."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def line_keys(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Each distinct key of at least one code point of each row's text, as h1, h2, after the columns to keep."""
    key = F.explode(F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), line_key))).alias("key")
    return docs.select(*keep, key).where("key != ''").select(*keep, *hashed(F.col("key"), "h1", "h2"))


def add_documents(runs: LineRuns, docs: DataFrame, text_col: str = "text", batches: int = 1) -> None:
    """Adds the keys of the documents' lines. With several batches, a document's batch comes from its text's hash. Null texts have no
    keys; repeated rows count each; an empty table adds an empty run."""
    rows = docs.select(whole_text(text_col).alias("text"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(batches)).cast("int"))
    runs.add_all(line_keys(rows, "text", "batch"), batches)


def _positions(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """t1, t2 (the text's hash) and dropped, the positions of its lines whose key is frequent; texts without any are absent."""
    lines = rows.select("t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("t1", "t2", "pos", line_key(F.col("line")).alias("key")).where("key != ''").select("t1", "t2", "pos", *hashed(F.col("key"), "h1", "h2"))
    return keyed.join(frequent, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set("pos").alias("dropped"))


def without_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of ``docs``), n_lines, n_dropped and kept: the text without the lines whose key (h1, h2) is in ``frequent``."""
    text = F.coalesce(F.col("row").getItem(text_col).cast("string"), F.lit(""))
    hashes = docs.select(whole_row(docs)).select("row", *hashed(text, "t1", "t2"))
    # written, so that the join below has a shuffle of its own on both sides and Spark can split a text with many copies
    found = written(_positions(docs.select(whole_text(text_col).alias("text")).select("text", *hashed(F.col("text"), "t1", "t2")), frequent))
    joined = hashes.join(found, ["t1", "t2"], "left").select("row", "dropped", text.alias("text")).withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.select("row", F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """row (a struct of all columns of ``docs``), n_lines, n_dropped, kept. A line whose key occurs in at least ``min_docs`` documents is
    dropped from every document.

    Cases: a null or empty text is one empty line, which stays. A document counts once for a key however often it holds it; repeated
    rows are documents of their own; nulls elsewhere stay. Other columns may have any names, since they stay inside row. An empty table
    gives an empty result.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout, min_docs=min_docs)
    add_documents(runs, docs, text_col, batches)
    frequent = written(runs.frequent())
    runs.drop()
    return without_lines(docs, frequent, text_col)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return drop_frequent_lines(rows, min_docs, "text", batches).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def line_report_sql(min_docs: int = MIN_DOCS) -> str:
    """The same in DuckDB's SQL over the table documents (rows told apart by their number)."""
    key = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        s as (select r, string_split(text, chr(10)) as a from d),
        l as (select r, unnest(a) as line, unnest(range(len(a))) as pos from s),
        k as (select r, pos, line, {key} as key from l),
        f as (select key from k where key != '' group by key having count(distinct r) >= {min_docs}),
        g as (select k.r, count(*) as n_lines, count(f.key) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '') as kept
            from k left join f using (key) group by k.r)
        select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(kept) as kept_sha256 from d join g using (r)"""
