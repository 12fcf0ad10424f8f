"""The corpus pipeline: language identification, line deduplication, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as the docs of the next one. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import dart_minhash, langid, line_dedup, packing, pii
from siltstone.llm.common import fields, table, whole_row, written

#: A document is rejected if its language can't be told, or is told with less than this posterior.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told; documents without a letter, or torn between languages, go.

    Null and empty texts have no letter and go; if there is nothing to learn from, so does everything. Ties between languages have a posterior
    of one half at most and stay only at exactly that. Repeated rows are judged alike. All columns stay, whatever their names. An empty table stays empty.
    """
    model = langid.fit_model(docs)
    judged = docs.select(whole_row(docs), langid.prediction(model)(F.col("text")).alias("judged"))
    return judged.where((F.col("judged.lang_pred") != langid.UNKNOWN) & (F.col("judged.score") >= MIN_LANGUAGE_SCORE)).select(*fields(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten documents hold; texts and their n_chars change, documents stay.

    A null text stays null with n_chars 0. Repeated rows are documents of their own. All columns stay, whatever their names. An empty table stays empty.
    """
    done = line_dedup.drop_frequent_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row").getItem("text"))
    return done.select(*fields(docs, text=text, n_chars=F.length(F.coalesce(text, F.lit(""))).cast("bigint")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one with the least doc_id.

    Null and empty texts are one class. Of several rows with one doc_id one stays. Rows without doc_id stay. All columns stay, whatever their
    names. An empty table stays empty.
    """
    return dart_minhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks of its kind, and counts n_chars anew.

    A null text stays null with n_chars 0. Rows are independent, so repeated rows repeat. All columns stay, whatever their names. An empty table stays
    empty.
    """
    clean = pii.redact(docs)
    return clean.select(whole_row(clean)).select(*fields(clean, n_chars=F.length(F.coalesce(F.col("row").getItem("text"), F.lit(""))).cast("bigint")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, one row per piece with its token ids."""
    return packing.pack(docs, added_tokens=True)


STAGES = [("language", language_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: Tokenizing, trees and sketches have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
