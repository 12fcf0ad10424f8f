"""Packing, tree BPE and longest-match counts against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe_tree, packing, token_counts
from siltstone.llm.pretoken import MATCHES, Chunked

RANKS = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = bpe_tree.TreeBPE(RANKS)
CHUNKED = Chunked(bpe_tree._chunk_encoder(BPE))
TEXTS = ["", " ", "\n", "a", "Hello  world\n\n  again ", "it's we'll 'S", "x\t\ty \u3000z", "日本語 ñandú 𝒳", "a \n b\n \nc", "<|endoftext|>", "1234 ５６", "the " * 3000, "a" * 5000, " " * 5000 + "b", "\r\n\r\n x", "e\u0301\u0301 é"]


def test_every_token_encodes_to_itself():
    assert all(BPE.merged(b) == (i,) for b, i in RANKS.items())


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    assert bpe_tree._concatenated(CHUNKED(text)) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeht ingñ'sS.,\n\t 12_日")), max_size=80))
def test_any_text(text):
    ids = bpe_tree._concatenated(CHUNKED(text))
    assert ids == LIBRARY.encode_ordinary(text) and BPE.decode(ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"th", b"ing", b" ", b"=", b"\xc3", b"\xa9"]), max_size=120))
def test_joining_equals_merging(parts):
    data = b"".join(parts)
    assert not data or BPE.encode(data) == BPE.merged(data)
    assert not data or BPE._merged_by_heap(data) == (BPE.merged(data) if len(data) <= 64 else BPE.encode(data))


def test_digests(spark):
    rows = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe_tree.encoded_digests(rows).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        ids = LIBRARY.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: bytes(r.data).decode() for r in bpe_tree.decode(bpe_tree.encode(rows)).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))


def test_packing_is_whole_and_unpadded(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = [*TEXTS, "word soup " * 9000, None]
    rows = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, length int").repartition(3)
    got = packing.pack(rows).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        at = 0
        for r in mine:
            assert r.start == at and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_piece_lengths():
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(2048) == [2048] and packing.piece_lengths(4096 + 13) == [2048, 2048, 8, 4, 1]


LONGEST = max(map(len, RANKS))


def greedy(word, vocabulary, longest=1 << 30):
    n = at = 0
    while at < len(word):
        end = max((e for e in range(at + 1, min(len(word), at + longest) + 1) if word[at:e] in vocabulary), default=None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_longest_match_bytes():
    automaton, rng = token_counts.byte_automaton(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("thingeros ") for _ in range(rng.randrange(30))).encode()
        assert automaton.count(word) == greedy(word, RANKS)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=15))
def test_longest_match_word_pieces(first, later, word):
    """With separate vocabularies for the start and the rest of a word, and unknown words."""
    automaton = token_counts.LongestMatch([map(ord, w) for w in first], [map(ord, w) for w in later])
    n = at = 0
    while at < len(word):
        end = max((e for e in range(at + 1, len(word) + 1) if word[at:e] in (later if at else first)), default=None)
        if end is None:
            n = 1
            break
        at, n = end, n + 1
    assert automaton.count(map(ord, word)) == n


def test_counts(spark):
    rows = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id bigint, text string")
    for r in token_counts.token_counts(rows).collect():
        words = MATCHES.findall(([*TEXTS, ""])[r.doc_id])
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy(w.encode(), RANKS, LONGEST) for w in words)


def test_added_token_in_a_text(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x  y", "one\n<|endoftext|>\n two<|endoftext|>", "<|endoftext", "<|<|endoftext|>|>", "é  <|endoftext|>é" * 3]
    got = {}
    for r in sorted(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), added_tokens=True).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_query_and_pipeline_take_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from siltstone.llm import queries

    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_packing(spark, str(tmp_path)).first().doc_tokens == 5
    assert corpus_pipeline.packing_stage(spark, df, str(tmp_path)).first().doc_tokens == 5


JSON = public_tokenizers.path("byte_bpe_50k.json")
JSON_LIBRARY = Tokenizer.from_file(JSON)


def library_ids(text, library=JSON_LIBRARY):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_knows_every_code_point_as_the_library_does():
    """All assigned characters beside matches of each kind; and some unassigned ones, which another Unicode may count as letters and the library itself matches."""
    encode = packing._encoder(JSON, True)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    known, unknown = [c for c in points if packing.assigned(c)], [c for c in points if not packing.assigned(c)]
    assert {"\n", "a", "ß", "日", "\x85", "\u200b", "\ue000"} <= set(known) and {"\u0558", "\U000323b0"} <= set(unknown)
    for chars in (known, unknown[:: len(unknown) // 4000], [c for c in unknown if c < "\u3000" or "\U000323b0" <= c < "\U000323c0"]):
        for at in range(0, len(chars), 500):
            text = "".join([f"a{c}1{c}!{c}{c} b {c}'s " for c in chars[at : at + 500]])
            assert encode(text) == library_ids(text)
    for c in "\u0558", "\U000323b0":
        for text in (c, f"{c}'s it's", f"a{c}'ll!!  b", f"x {c}y\n {c}'s<|endoftext|>{c}1"):
            assert encode(text) == library_ids(text)


def test_packing_of_texts_too_long_to_be_encoded_whole():
    encode = packing._encoder(JSON, True)
    rng = random.Random(3)
    for text in (" ".join("".join(rng.choices("thingerosé,", k=rng.randrange(1, 12))) for _ in range(40_000)), "a" * 250_000, "x" + " " * 1_200_000 + "y", "é\n  " * 60_000):
        assert len(text) > packing.WHOLE_TEXT and encode(text) == library_ids(text)


def test_ranks_only_where_they_give_the_librarys_ids(tmp_path):
    """With b+c before a+b, the library never joins a and bc, though abc is a token."""
    from tokenizers import models, pre_tokenizers

    letters = [chr(c) for _, c in sorted(packing.byte_letters().items())]
    texts = ["abc", "xabc ab bc", "<abcabc>", "abab", "cabbc"]
    for n, (merges, same) in enumerate([([("a", "b"), ("ab", "c")], True), ([("b", "c"), ("a", "b"), ("ab", "c")], False), ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], False)]):
        tokens = dict.fromkeys([*letters, *("".join(m) for m in merges)])
        library = Tokenizer(models.BPE({t: len(tokens) - 1 - i for i, t in enumerate(tokens)}, merges))
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        library.save(path := f"{tmp_path}/{n}.json")
        assert (packing.ranked(library) is not None) == same
        for text in texts:
            assert packing._encoder(path)(text) == library_ids(text, library)
    assert packing.ranked(JSON_LIBRARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abeht ingñ'sS.,\n\t 12_日\u0558")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_packing_any_text(text):
    assert packing._encoder(JSON, True)(text) == library_ids(text)
