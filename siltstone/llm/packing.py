"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces of power-of-two length: as many of the full length as fit,
then one for each binary digit of the rest. Pieces of equal length form a bucket, and each piece is a
sequence of its own, so no sequence crosses documents and nothing is padded. A trainer draws batches
from one bucket at a time.

Cases: a null or empty text is the end id alone, one piece of length 1. Repeated rows and repeated
doc_ids are packed independently. A null doc_id stays null. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_udf, whole_text
from .pretoken import MATCHES, Chunked, Remembered

MAX_TOKENS = 2048
END_ID = 1
#: Longer texts are cut into chunks, since the pattern of ``tiktoken`` gives up on very long runs of white space.
WHOLE_TEXT = 200_000
#: Letters of a Latin word, perhaps after a space, are one match of the pattern.
_ONE_WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
PIECES = "array<struct<start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint, sequence_id: bigint, ids: binary>>"


def piece_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Full-length pieces, then the binary digits of the rest, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def assigned(text: str) -> bool:
    """Whether Python's Unicode knows every character. Others may be letters to a newer one, so the pattern's
    classes can differ between libraries there, and only there (assigned ones are all tested)."""
    return text.isascii() or text.replace("\n", "").isprintable() or "Cn" not in map(unicodedata.category, set(text))


def ranked(tokenizer) -> tuple[Callable[[str], list[int]], list[int]] | None:
    """A function from a text to ranks, by ``tiktoken``, which is faster on whole texts, and the id of each rank; None if ids could differ from the library's.

    Both join the neighbours of the lowest rank, leftmost first; but the library joins listed pairs only, and tiktoken
    any two that spell a token. Let two neighbours spell a token. So far nothing around them took part, so they are
    what the token's own text passes through when it is encoded alone. If that ends in the token, its last two parts are
    the one pair listed for it. So the two agree if every token has one pair and encodes to itself, which is tried here."""
    import tiktoken

    model, letters = json.loads(tokenizer.to_str())["model"], byte_letters()
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    tokens, byte_of = [*map(chr, (letters[b] for b in range(256))), *joined], {chr(v): b for b, v in letters.items()}
    ids, merge = model["vocab"], tokenizer.model.tokenize
    if len(set(tokens)) < len(tokens) or not all(t in ids and byte_of.keys() >= set(t) for t in tokens):
        return None
    if any([part.id for part in merge(t)] != [ids[t]] for t in tokens):
        return None
    ranks = {bytes([byte_of[c] for c in t]): rank for rank, t in enumerate(tokens)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, [ids[t] for t in tokens]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, added_tokens: bool = False):
    """Made once in a worker, so that what is remembered serves all its tasks. A function from a text to its ids as little-endian unsigned 32-bit integers.
    Whole texts are encoded by ranks where these give the library's ids. Else, and in very long texts, matches of the pattern go to the library's
    merging model once each; their ids are remembered, and so are those of the chunks between spaces. Texts with unassigned characters are matched and merged by the library. With
    ``added_tokens`` a text is cut at the literals of added tokens, which have ids of their own, as in the library by default; where added
    tokens also take in what is around them, the library does it all."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    merge, letters = tokenizer.model.tokenize, byte_letters()
    added = tokenizer.get_added_tokens_decoder() if added_tokens else {}
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        return lambda text: b"".join([i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids])
    literals = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
    spelled = [i.to_bytes(4, "little") for i in range(1 + max(tokenizer.get_vocab().values()))]

    to_ranks, ids = ranked(tokenizer) or (None, [])
    by_rank = [spelled[i] for i in ids].__getitem__

    def match_ids(match: str) -> bytes:
        return b"".join([spelled[t.id] for t in merge(match.encode("utf-8").decode("latin-1").translate(letters))])

    matches = Remembered(match_ids, 100_000).__getitem__

    def chunk_ids(chunk: str) -> bytes:
        if _ONE_WORD(chunk):
            return match_ids(chunk)
        return b"".join(map(matches, MATCHES.findall(chunk)))

    chunked = Chunked(chunk_ids)

    def plain(text: str) -> bytes:
        if not assigned(text):
            return b"".join([spelled[t.id] for match, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text) for t in merge(match)])
        if to_ranks and len(text) <= WHOLE_TEXT:
            return b"".join(map(by_rank, to_ranks(text)))
        return b"".join(chunked(text))

    cut = re.compile("(" + "|".join(map(re.escape, sorted(literals, key=len, reverse=True))) + ")").split

    def encode(text: str) -> bytes:
        for literal in literals:
            if literal in text:  # every second part is a literal
                return b"".join([literals[part] if n % 2 else plain(part) for n, part in enumerate(cut(text))])
        return plain(text)

    return encode


def _maker(vocabulary: str, most: int, end_id: int, with_ids: bool, added_tokens: bool):
    def make():
        from pyspark import TaskContext

        encode, end = _encoder(vocabulary, added_tokens), end_id.to_bytes(4, "little")
        task = TaskContext.get()
        task = task.partitionId() if task else 0
        placed = [0] * most.bit_length()

        def pieces(text: str | None) -> list[dict]:
            buffer = memoryview(encode(text or "") + end)
            n, start, out = len(buffer) // 4, 0, []
            for length in piece_lengths(n, most):
                level = length.bit_length() - 1
                ids = buffer[4 * start : 4 * (start + length)]
                out.append({"start": start, "length": length, "ids_crc32": zlib.crc32(ids), "doc_tokens": n, "sequence_id": level << 56 | task << 32 | placed[level], "ids": bytes(ids) if with_ids else None})
                placed[level] += 1
                start += length
            return out

        return lambda texts: [pieces(t) for t in texts]

    return make


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for,
    the piece's ids as little-endian unsigned 32-bit integers.

    ``sequence_id`` holds the bucket (log2 of the length) in its highest bits, then the task, then the place in
    the task's run for that bucket, so a bucket is a range of ids and no shuffle is needed to number it.
    With ``added_tokens``, the literals of the vocabulary's added tokens get their ids; else they are ordinary text.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    small_batches(docs.sparkSession)
    cut = text_udf(_maker(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), max_tokens, end_id, with_ids, added_tokens), PIECES)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", cut("text").alias("pieces"))
    out = rows.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*", F.lit(0).cast("bigint").alias("offset"))
    return out if with_ids else out.drop("ids")
