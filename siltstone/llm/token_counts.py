"""Token counts by greedy longest match, in time linear in the text, without building the pieces.

A trie of the vocabulary gets a failure link for each node: where matching goes on once the longest tokens at
the front of the node's string are popped; and with it the number of tokens popped. So each character is read
once, and each failed step adds a number made beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tree import read_ranks
from .common import small_batches, text_udf, whole_text
from .pretoken import MATCHES, Chunked


class LongestMatch:
    """Greedy longest-match counter over sequences of small integers (bytes, or code points).

    ``later`` is the vocabulary of pieces that do not start a word (word-piece's marked ones, without the mark); None: the
    same as ``first``. A word that can't be cut into known pieces counts as ``unknown`` tokens.
    """

    BITS = 21

    def __init__(self, first: Iterable[Iterable[int]], later: Iterable[Iterable[int]] | None = None, unknown: int = 1):
        self.unknown = unknown
        self.goto: dict[int, int] = {}
        self.final: list[bool] = [False]
        depth_order: list[tuple[int, int, int]] = []
        self._add(0, first, depth_order)
        self.root2 = 0
        if later is not None:
            self.root2 = len(self.final)
            self.final.append(False)
            self._add(self.root2, later, depth_order)
        self._link(depth_order)

    def _add(self, root: int, words: Iterable[Iterable[int]], order: list) -> None:
        bits = self.BITS
        for word in words:
            node = root
            for c in word:
                key = node << bits | c
                child = self.goto.get(key)
                if child is None:
                    child = self.goto[key] = len(self.final)
                    self.final.append(False)
                    order.append((node, c, child))
                node = child
            if node != root:
                self.final[node] = True

    def _link(self, edges: list[tuple[int, int, int]]) -> None:
        """Breadth first, so that what a node needs of shallower nodes is there."""
        n, bits, goto, final = len(self.final), self.BITS, self.goto, self.final
        self.fail, self.popped = [-1] * n, [0] * n
        children: dict[int, list[tuple[int, int]]] = {}
        for parent, c, child in edges:
            children.setdefault(parent, []).append((c, child))
        level = [0] if self.root2 == 0 else [0, self.root2]
        while level:
            below = []
            for parent in level:
                for c, v in children.get(parent, ()):
                    below.append(v)
                    if final[v]:
                        self.fail[v], self.popped[v] = self.root2, 1
                        continue
                    z, count = self.fail[parent], self.popped[parent]
                    while z >= 0 and z << bits | c not in goto:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = goto[z << bits | c], count
            level = below

    def count(self, word: Iterable[int]) -> int:
        """The number of pieces of one word; 0 for an empty one."""
        bits, goto, fail, popped = self.BITS, self.goto, self.fail, self.popped
        node, n, some = 0, 0, False
        for c in word:
            some = True
            while (child := goto.get(node << bits | c)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return self.unknown
            node = child
        if not some:
            return 0
        while node != self.root2:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return self.unknown
        return n


@lru_cache(maxsize=4)
def byte_automaton(path: str) -> LongestMatch:
    return LongestMatch(read_ranks(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, n_words (matches of the pattern) and n_tokens (greedy longest pieces of each match's bytes, by the
    vocabulary of a rank file) of each whole text.

    Cases: null and empty texts count 0. Rows are independent, so repeated rows repeat and a null doc_id stays.
    Other columns are not read. An empty table gives an empty result.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        automaton = byte_automaton(path)

        def of(chunk: str) -> int:
            """Both counts in one number, so that a text's are one sum."""
            words = MATCHES.findall(chunk)
            return len(words) << 40 | sum(automaton.count(w.encode("utf-8", "surrogatepass")) for w in words)

        chunked = Chunked(of)

        def counts(text: str | None) -> dict:
            total = sum(chunked(text or ""))
            return {"n_words": total >> 40, "n_tokens": total & (1 << 40) - 1}

        return lambda texts: [counts(t) for t in texts]

    small_batches(docs.sparkSession)
    run = text_udf(make, "struct<n_words: bigint, n_tokens: bigint>")
    return docs.select(F.col(id_col).alias("doc_id"), run(whole_text(text_col)).alias("r")).select("doc_id", "r.*")
