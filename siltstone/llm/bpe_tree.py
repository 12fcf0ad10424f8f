"""Byte-level BPE as a monoid over a tree: encode halves, join neighbours; decoding concatenates.

Joining two encodings looks only at the boundary. A list of tokens is the encoding of its bytes exactly if
each pair of neighbours is the encoding of its own bytes: merges always take the lowest rank, so a merge across
a boundary would show already in the two tokens that touch there. So when the pair at the boundary is stable,
the encodings just concatenate; else a window around the boundary is encoded anew and grows, doubling, on each
side where its outer token does not form a stable pair with the token outside. Once both outer pairs are stable,
nothing outside the window can change.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_udf, whole_text
from .pretoken import MATCHES, Chunked

ROOM = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder for a table of ranks in which every byte has one."""

    LEAF = 8

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The encoding by its definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(data)
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        if n > 64:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(n)]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return tuple(ranks[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.merged(self.token[a] + self.token[b]) == (a, b)
            if len(self.pairs) < ROOM:
                self.pairs[a, b] = known
        return known

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            left_ok = i == len(left) or self.stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            if not left_ok:
                i = min(len(left), 2 * i)
            if not right_ok:
                j = min(len(right), 2 * j)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one match of the pattern."""
        n = len(data)
        if n <= self.LEAF:
            if (known := self.leaves.get(data)) is None:
                known = self.merged(data) if n else ()
                if len(self.leaves) < ROOM:
                    self.leaves[data] = known
            return known
        half = self.LEAF << max(0, ((n - 1) // self.LEAF).bit_length() - 1)
        return self.joined(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tree_bpe(path: str) -> TreeBPE:
    return TreeBPE(read_ranks(path))


def _concatenated(parts: list[tuple[int, ...]]) -> list[int]:
    """Matches of the pattern are encoded separately, so between them joining is concatenation."""
    return list(chain.from_iterable(parts))


def _chunk_encoder(bpe: TreeBPE):
    def ids(chunk: str) -> tuple[int, ...]:
        return tuple(_concatenated([bpe.encode(m.encode("utf-8", "surrogatepass")) for m in MATCHES.findall(chunk)]))

    return ids


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids of the whole text. Null and empty texts have no ids."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        chunked = Chunked(_chunk_encoder(tree_bpe(path)))
        return lambda texts: [_concatenated(chunked(t or "")) for t in texts]

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), text_udf(make, "array<int>")(whole_text(text_col)).alias("ids"))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and data, the bytes that the column ids stands for. Null ids give null."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        bpe = tree_bpe(path)
        return lambda rows: [None if r is None else bpe.decode(r) for r in rows]

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", text_udf(make, "binary")(F.col("ids")).alias("data"))


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: encoded, then decoded from the ids, without
    moving either out of the worker.

    Cases: null and empty texts have 0 tokens and the digests of nothing. Rows are independent, so repeated rows
    repeat and a null doc_id stays. Other columns are not read. An empty table gives an empty result.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        bpe = tree_bpe(path)
        ids_of = _chunk_encoder(bpe)

        def both(chunk: str):
            ids = ids_of(chunk)
            return ids, b" ".join(b"%d" % i for i in ids)

        chunked = Chunked(both)

        def digest(text: str | None) -> dict:
            parts = chunked(text or "")
            ids = _concatenated([p[0] for p in parts])
            return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(b" ".join([p[1] for p in parts])).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest()}

        return lambda texts: [digest(t) for t in texts]

    small_batches(docs.sparkSession)
    run = text_udf(make, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    return docs.select(F.col(id_col).alias("doc_id"), run(whole_text(text_col)).alias("r")).select("doc_id", "r.*")
