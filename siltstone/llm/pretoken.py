"""Splitting texts into the matches of a byte-level BPE pattern, with results remembered per chunk.

A space that follows a character other than white space always begins a new match, since in the
pattern a space occurs only at the start of a match or inside a run of white space. So a text
without runs of white space that contain a space can be cut before each space, and what belongs
to each chunk (token ids, counts) can be remembered. Other texts are matched as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex

#: White space other than space and line feed.
_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MATCHES = regex.compile(public_tokenizers.PATTERN)


class Remembered(dict):
    """chunk → result, computed when first asked for. At most ``room`` results are kept; beyond it
    results are computed again, so memory is bounded and results are the same."""

    def __init__(self, compute: Callable[[str], object], room: int = 400_000):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(self) < self.room and len(key) <= 64:
            self[key] = value
        return value


class Chunked:
    """Maps a text to the results of its chunks, in order. ``compute`` gets a chunk: a text which, encoded
    alone, gives the same as in its place."""

    def __init__(self, compute: Callable[[str], object], room: int = 400_000):
        self.first = Remembered(compute, room // 4)
        self.later = Remembered(lambda key: compute(" " + key), room)
        self.get_first, self.get_later = self.first.__getitem__, self.later.__getitem__

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if "  " in text or "\n " in text or _OTHER_SPACE.search(text):
            return [self.get_first(m) for m in MATCHES.findall(text)]
        first, *later = text.split(" ")
        out = [self.get_first(first)] if first else []
        out += map(self.get_later, later)
        return out
