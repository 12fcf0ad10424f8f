"""Language identification: words first, then ever shorter character n-grams.

Each word of a text that the model knows adds its log frequency per language. A word it doesn't know is looked up by
its character n-grams, with marks at both ends: the longest length of which any n-gram is known decides, and adds the
mean of the known n-grams' log frequencies. The language with the largest sum wins; its score is its posterior, with
the sum taken as the mean per word times at most ``EVIDENCE`` words.

The model is fitted on a bounded sample of labelled rows, at most about ``max_train_rows`` per language by a hash of the id,
and keeps at most ``max_words`` words and ``max_grams`` n-grams per length and language: that bounds what is sent to the
workers. What was seen once counts too. Predictions cover every row and every text as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_udf, whole_text
from .pretoken import Remembered

MAX_TRAIN_ROWS = 5_000
MAX_WORDS = 20_000
MAX_GRAMS = 10_000
ORDERS = (5, 4, 3, 2, 1)
EVIDENCE = 30
UNKNOWN = "und"

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Log frequencies: rows of ``table`` are words and n-grams, columns are languages."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    prior: np.ndarray

    def word_row(self, word: str) -> np.ndarray:
        if (i := self.words.get(word)) is not None:
            return self.table[i]
        for order in ORDERS:
            known = [self.grams[g] for g in grams(word, order) if g in self.grams]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.langs))


def fit(counted: list[tuple[str, str, str, int]]) -> Model:
    """From rows (lang, kind, item, n); kind is "w" for words, else the order of the n-gram. Each count, with one half added, is
    set against all counts of its kind and language, with one half added for every item of the kind in any language and one for others.
    So a language with few counts comes near to an even share for each item, not to a high floor."""
    langs = sorted({r[0] for r in counted})
    totals: dict[tuple[str, str], int] = Counter()
    counts: dict[tuple[str, str], dict[str, int]] = {}
    for lang, kind, item, n in counted:
        totals[lang, kind] += n
        counts.setdefault((kind, item), {})[lang] = n
    items = Counter(kind for kind, _ in counts)
    words, ngrams, rows = {}, {}, []
    for (kind, item), by in sorted(counts.items()):
        (words if kind == "w" else ngrams)[item] = len(rows)
        rows.append([math.log((by.get(lang, 0) + 0.5) / (totals[lang, kind] + 0.5 * (items[kind] + 1))) for lang in langs])
    return Model(langs, words, ngrams, np.array(rows, float).reshape(len(rows), len(langs)), np.zeros(len(langs)))


def training_counts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_train_rows: int, max_words: int, max_grams: int) -> list[tuple[str, str, str, int]]:
    """Counts per language over the sample, each kind cut to its most frequent items; ties go to the smaller item."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("key"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(1).cast("bigint")
    for lang, n in sorted(sizes.items()):
        if n > max_train_rows:
            rate = F.when(F.col("lang") == lang, F.lit(-(-n // max_train_rows)).cast("bigint")).otherwise(rate)
    # by id, so that copies of one text are neither all in nor all out; rows without id by text
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce("key", F.concat(F.lit("text:"), "text"))), rate) == 0)
    return _counted(sample, max_words, max_grams)


def _counted(sample: DataFrame, max_words: int, max_grams: int) -> list[tuple[str, str, str, int]]:
    def partial(frames):
        import pandas as pd

        words: dict[str, Counter] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        for lang, count in words.items():
            by: dict[str, Counter] = {"w": count}
            for word, n in count.items():
                for order in ORDERS:
                    mine = by.setdefault(str(order), Counter())
                    for g in grams(word, order):
                        mine[g] += n
            for kind, items in by.items():
                if items:  # short words have no long n-grams
                    yield pd.DataFrame({"lang": lang, "kind": kind, "item": list(items), "n": list(items.values())})

    from pyspark.sql import Window as W

    counts = sample.mapInPandas(partial, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    # the literal limit applies before the shuffle, too
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(max_words, max_grams)).where((F.col("kind") == "w") & (F.col("r") <= max_words) | (F.col("kind") != "w") & (F.col("r") <= max_grams))
    return [(r.lang, r.kind, r.item, r.n) for r in top.select("lang", "kind", "item", "n").collect()]


def _predictor(model: Model):
    width = len(model.langs)
    room = 300_000
    table = np.zeros((room + 1, width))
    filled = [0]

    def place(word: str) -> int:
        i = filled[0]
        table[i] = model.word_row(word)
        filled[0] = i + 1
        return i

    seen = Remembered(place, room)

    def predict(text: str | None) -> dict:
        words = WORDS.findall((text or "").lower())
        if not words or not width:
            return {"lang_pred": UNKNOWN, "score": 0.0, "n_words": len(words)}
        total, i = np.zeros(width), 0
        while i < len(words):
            part = words[i : i + 50_000]
            if filled[0] + len(part) > room:  # forget all, so that memory stays bounded
                seen.clear()
                filled[0] = 0
            total += table[np.fromiter(map(seen.__getitem__, part), np.int64, len(part))].sum(axis=0)
            i += len(part)
        best = int(np.argmax(total))
        mean = total / len(words)
        z = np.exp((mean - mean[best]) * min(len(words), EVIDENCE))
        return {"lang_pred": model.langs[best], "score": float(1.0 / z.sum()), "n_words": len(words)}

    return predict


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_rows: int = MAX_TRAIN_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learns from the rows that are not held out. A null id counts as not held out."""
    small_batches(docs.sparkSession)
    return fit(training_counts(docs.where(~F.coalesce(held_out(id_col), F.lit(False))), id_col, text_col, lang_col, max_train_rows, max_words, max_grams))


def prediction(model: Model):
    """A column function: text → struct<lang_pred, score, n_words>. Only the text is used."""

    def make():
        p = _predictor(model)
        return lambda texts: [p(t) for t in texts]

    return text_udf(make, "struct<lang_pred: string, score: double, n_words: bigint>")


def predict(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words.

    Cases: a null text, or one without a letter, is "und" with score 0; so is everything if there was nothing to learn from.
    Ties between languages go to the first by name. Rows are independent, so repeated rows repeat; a null doc_id stays and is not
    held out. Other columns are not read. An empty table gives an empty result.
    """
    model = model or fit_model(docs, id_col, text_col, **fitting)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), whole_text(text_col).alias("text"))
    return rows.select("doc_id", "held_out", prediction(model)("text").alias("r")).select("doc_id", "held_out", "r.*")
