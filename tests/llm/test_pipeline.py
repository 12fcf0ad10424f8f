"""The pipeline's stages on small inputs, and every operator on empty and odd tables."""

import os
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from siltstone.llm import bpe_tree, dart_minhash, langid, line_dedup, packing, pii, spotsigs, token_counts, url_reputation, vptree

from .brute import kept_lines, near_classes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    text = "the stone and the river lie under the hills of moss and fern where the old road bends"
    german = "der stein und der fluss liegen unter den hügeln aus moos und farn wo die alte strasse biegt"
    rows = [(i, f"{text} {i}" if i % 2 else f"{german} {i}", "en" if i % 2 else "de", "s", 0) for i in range(40)]
    rows += [(100, "12 !!", "en", "s", 5), (101, None, "en", "s", 0), (102, f"{text} again\nmail me: a@b.org", "en", "s", 0), (103, f"{text} again\nmail me: a@b.org", "en", "s", 0)]
    rows += [(200 + i, f"Share This Page \nunique words number {i} w{i} x{i} y{i} z{i} the and of", "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), DOCS)
        ids = {r.doc_id for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert ids == {r[0] for r in rows} - {100, 101}
        if name == "lines":
            assert all("Share" not in r.text for r in docs.collect()) and len(ids) == len(rows) - 2
        if name == "near_duplicates":
            assert 103 not in ids and 102 in ids
    assert all("a@b.org" not in r.text and r.n_chars == len(r.text) for r in docs.collect())
    packed = P.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 100 and out.select("sequence_id").distinct().count() == out.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_is_brute_force(spark, tmp_path):
    """The whole pipeline on documents of the smallest table, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    predict = langid._predictor(langid.fit_model(docs))
    rows = {i: t for i, t in rows.items() if (p := predict(t))["lang_pred"] != "und" and p["score"] >= P.MIN_LANGUAGE_SCORE}
    rows = {i: "\n".join(stay) for i, (_, stay) in kept_lines(list(rows.items()), 10).items()}
    classes = near_classes(list(rows.items()))
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    judge = pii.fit_judge(pii.sample_contexts(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), "text", pii.SAMPLE_ROWS))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = set()
    for i, t in rows.items():
        fixed = pii.base_spans(t)
        ids = [*library.encode(pii.redact_text(t, [*fixed, *judge.added(t, fixed)]), add_special_tokens=False).ids, 1]
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want.add((i, at, tuple(ids[at : at + n])))
            at += n
    got = {(r.doc_id, r.start, struct.unpack(f"<{r.length}I", r.ids)) for r in P.run(spark, str(tmp_path)).collect()}
    assert got == want


CLASHING = ["_judged", "_text", "_kept", "_t1", "T1", "_lines", "row", "lines", "kept", "key", "r", "_r", "a.b", "judged", "class_id", "dropped", "a`b"]


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_keep_any_column_and_take_odd_rows(spark, name, stage):
    schema = DOCS + "".join(f", `{c.replace('`', '``')}` string" for c in CLASHING)
    more = [f"value of {c}" for c in CLASHING]
    text = "the stone and the river lie under the hills of moss and fern where the old road bends"
    rows = [(1, text, "en", "s", 1, *more), (1, text, "en", "s", 1, *more), (1, "another text of the same number", "en", "s", 1, *more), (None, text, "en", None, None, *more), (None, None, None, None, None, *more), (2, None, "en", "s", 0, *more), (3, "", None, "s", 0, *more), (4, "wort " * 100_000, "de", "s", 0, *more)]
    out = stage(spark, spark.createDataFrame(rows, schema), "")
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
    else:
        assert out.columns == spark.createDataFrame([], schema).columns
        got = out.collect()
        assert all(list(r)[5:] == more for r in got)
        ids = sorted((r.doc_id or 0) for r in got)
        assert ids == {"language": [0, 1, 1, 1, 4], "lines": [0, 0, 1, 1, 1, 2, 3, 4], "near_duplicates": [0, 0, 1, 2, 4], "personal_data": [0, 0, 1, 1, 1, 2, 3, 4]}[name]
    empty = stage(spark, spark.createDataFrame([], schema), "")
    assert empty.count() == 0


OPERATORS = {
    "pii": lambda d: pii.find(d, judge=pii.Judge(pii.BoostedTrees(), [1.1] * 4)),
    "langid": langid.predict,
    "near": dart_minhash.near_duplicates,
    "lines": line_dedup.line_report,
    "pack": packing.pack,
    "counts": token_counts.token_counts,
    "spots": spotsigs.compare_edited,
    "bpe": bpe_tree.encoded_digests,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_odd_tables(spark, name):
    columns = "doc_id bigint, text string, lang string, pieces string, r string, bands string, n_lines string, start string, _1 string"
    assert OPERATORS[name](spark.createDataFrame([], columns)).count() == 0
    odd = spark.createDataFrame([(1, None, None, *"abcdef"), (None, "", None, *"abcdef"), (None, None, None, *"abcdef"), (2, "Ünï ☃ text", "en", *"abcdef"), (2, "Ünï ☃ text", "en", *"abcdef"), (3, "x" * 200_000, "en", *"abcdef")], columns)
    out = OPERATORS[name](odd)
    assert out.select("doc_id").distinct().count() == 4 and (name == "pack" or out.count() == 6)


def test_empty_vectors_and_pages(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vptree.search(vptree.build_index(none), none).count() == 0
    pages, labels = spark.createDataFrame([], "page_id bigint, url string, html string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert url_reputation.judge(pages, labels).count() == 0
    one = spark.createDataFrame([(None, None, None), (1, "http://a.b/c", None)], "page_id bigint, url string, html string")
    assert [r.verdict for r in url_reputation.judge(one, labels).collect()] == ["allow", "allow"]
