"""Personal data, language identification and host reputation."""

import hashlib
import random
import re
import zlib

import pytest

from siltstone.llm import langid, pii, url_reputation


def base(text):
    """The fixed patterns as written, by plain regular expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_fixed_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(["a.@", "1.2", "+1 (2)-", "4242 -", "x@y.z", "é\n"])) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == base(text)


JUDGE = pii.fit_judge(["over the hills", "ein langer Weg", "la casa de piedra", ""])


@pytest.mark.parametrize("text,kind", [("mail john.smith (at) example (dot) com now", "email"), ("call (415) 555-1234 today", "phone"), ("card 4111.1111.1111.1111 ok", "card"), ("host 10[.]0[.]0[.]1 there", "ip"), ("see 2001:db8:85a3:0:0:8a2e:370:7334 up", "ip")])
def test_loose_forms_are_added(text, kind):
    assert [pii.KINDS[k] for _, k, _ in JUDGE.added(text, pii.base_spans(text))] == [kind]


@pytest.mark.parametrize("text,form", [("write to john.doe (at) example.com now", "john.doe (at) example.com"), ("contact ann[at]example.org today", "ann[at]example.org"), ("jane(at)uni.example.de", "jane(at)uni.example.de"), ("reach lea.b [AT] shop.fr, please", "lea.b [AT] shop.fr"), ("write john.doe at example.com now", "john.doe at example.com")])
def test_bracketed_at_with_a_plain_dot(spark, text, form):
    span = (text.index(form), 0, text.index(form) + len(form))
    assert span in pii.candidates(text)
    assert JUDGE.added(text, pii.base_spans(text)) == [span]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.find(df, judge=JUDGE).first().spans == f"email:{span[0]}:{span[2]}"
    assert pii.redact(df, judge=JUDGE).first().text == text.replace(form, "<EMAIL>")


@pytest.mark.parametrize("text", ["they met at home. In the morning it rained", "look at it. Then go", "we stayed at the inn. It was late", "at noon. De la casa"])
def test_plain_at_before_a_sentence_end_stays(text):
    assert JUDGE.added(text, pii.base_spans(text)) == []


def test_every_positive_form_is_a_candidate():
    import numpy as np

    forms = pii._forms(np.random.default_rng(11))
    for kind, form, label in (next(forms) for _ in range(8000)):
        assert not label or (0, kind, len(form)) in pii.candidates(form), form


@pytest.mark.parametrize("text", ["", "plain words only", "number 9739312764672899 here", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "at 10:30:00 on 2024-01-15", "version 1.2.3.4.5", "look at the dot on it", "under the Apache License, Version 2.0."])
def test_harmless_text_stays(text):
    assert JUDGE.added(text, pii.base_spans(text)) == []


def test_find_and_redact(spark):
    texts = ["mail a.b@c.org or +1 (264) 555-7228.", None, "", "4111 1111 1111 1111 and 1.2.3.4", "x" * 100_000 + "@y.z"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    got = {r.doc_id: r for r in pii.find(df, judge=JUDGE).collect()}
    for i, t in enumerate(texts):
        spans = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == n for _, k, _ in spans) for n in range(4))
    red = {r.doc_id: r.text for r in pii.redact(df, judge=JUDGE).collect()}
    assert red[0] == "mail <EMAIL> or <PHONE>." and red[1] is None and red[3] == "<CARD> and <IP>" and red[4] == "<EMAIL>"


def corpus(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = langid.fit_model(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the stone and the river", "en"), ("der stein und der fluss", "de"), (None, "de"), ("the end", None)] * 20)]
    df = spark.createDataFrame([*rows, (1000, "12 34", "en"), (1001, None, None), (None, "the stone", None), (1002, "stein " * 60_000, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[None].lang_pred == "en" and not got[None].held_out and got[1002].lang_pred == "de"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    nothing = langid.predict(df.where("lang is null")).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_language_of_one_short_document(spark):
    rng = random.Random(5)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(150)] for lang, letters in (("en", "thesandiorw"), ("de", "derichunsgk"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rare = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5)
    df = spark.createDataFrame([*rows, (rare, "kjafti minn vinur", "is")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.5 for i, _, lang in rows)
    assert got[rare].lang_pred == "is" and not got[rare].held_out


def test_words_seen_once_are_kept(spark):
    df = spark.createDataFrame([(1, "ab ab cd", "x"), (2, "ef", "y")], "id bigint, text string, lang string")
    counts = langid.training_counts(df, "id", "text", "lang", 100, 100, 100)
    assert {(r[0], r[2], r[3]) for r in counts if r[1] == "w"} == {("x", "ab", 2), ("x", "cd", 1), ("y", "ef", 1)}
    model = langid.fit(counts)  # columns are x, y
    assert model.word_row("ab")[0] > model.word_row("ab")[1] and model.word_row("cd")[0] > model.word_row("cd")[1] and model.word_row("ef")[1] > model.word_row("ef")[0]


def test_unknown_words_back_off():
    model = langid.fit([("en", "w", "the", 5), ("de", "w", "der", 5), ("en", "3", "the", 3), ("de", "3", "der", 3), ("en", "1", "z", 1), ("de", "1", "z", 9)])
    assert model.word_row("the")[1] > model.word_row("the")[0]  # columns are de, en
    assert model.word_row("xtheq")[1] > model.word_row("xtheq")[0]
    assert model.word_row("z")[0] > model.word_row("z")[1]
    assert not model.word_row("q").any()


def test_rules(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/1", "http://a.example.com/fr", "http://b.net/es/", "http://b.net/de/", "http://net/fr/q", "http://example.com", "http://xexample.com/en/", "no scheme", None, "a://b.org?x=://c.com/", "http://notnet.org/fr/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(4, 0, 1), (4, None, None), (50, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, labels).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block")
    assert got[4][2] is None and got[6] == ("example.com", "", None, "allow") and got[7][2] == "com/"
    assert got[8][:2] == got[9][:2] == ("", "") and got[10][:2] == ("b.org", "") and got[11][2] is None


def test_reputation_shrinks(spark):
    outcomes = [("bad.shop.org", 1)] * 40 + [("good.shop.org", 0)] * 40 + [("new.shop.org", 1)] + [(f"h{i}.site{i % 9}.net", int(i % 10 == 0)) for i in range(200)]
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in outcomes} | {"unseen.shop.org", "a.b.co.uk", "1.2.3.4", "x@y.org:80"}], "host string")
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(outcomes, "host string, bad int"), hosts).collect()}
    assert got["bad.shop.org"].bad_bound > 0.5 > got["new.shop.org"].bad_bound and got["good.shop.org"].bad_mean < 0.2
    assert got["good.shop.org"].bad_mean < got["unseen.shop.org"].bad_mean < got["bad.shop.org"].bad_mean
    assert (got["a.b.co.uk"].domain, got["a.b.co.uk"].suffix) == ("b.co.uk", "co.uk") and got["1.2.3.4"].domain == "1.2.3.4" and got["x@y.org:80"].domain == "y.org"
