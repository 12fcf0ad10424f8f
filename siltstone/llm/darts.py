"""Sketches of weighted sets by hashed darts (DartMinHash).

Darts fall evenly on the plane of weight and rank that each element has. Its weight axis is cut into regions at 1, 2, 4, ... and the axis
of ranks into intervals; a hash of the element, the region and the interval says how many darts (a Poisson number) hit that cell, and at which
weight and rank. A set sees the darts below the weight that it gives the element, so two sets share all darts below the lesser of
their weights. A hash of the dart says for which coordinate it counts. A coordinate keeps its earliest dart: it is the same for two sets with
probability equal to their weighted Jaccard similarity, the sum of the lesser weights over that of the greater ones. Intervals are gone
through in order of rank, and only for sets that still have a coordinate without a dart.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .pretoken import Remembered

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP = U(0xD6E8FEB86659FD93)
FIRST, LONGEST = 1 / 4, 16.0
#: The greatest width of a weight region, and the least weight.
WIDEST, LEAST_WEIGHT = 32, 1 / 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + _GOLD).astype(U)
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    steps, p, total, n = [], np.exp(-mean), 0.0, 0
    while total < 1 - 1e-15 and n < 10 * mean + 40:
        total += p
        steps.append(total)
        n += 1
        p *= mean / n
    return np.array(steps)


def _regions(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each weight region that any element reaches: its width, the keys and owners of those elements, and what share of it they fill."""
    out, low, width, key = [], 0.0, 1.0, elements
    while len(elements):
        out.append((width, key, np.minimum((weights - low) / width, 1.0), owner))
        low, width = low + width, min(max(low + width, 1.0), float(WIDEST))
        over = weights > low
        elements, weights, owner = elements[over], weights[over], owner[over]
        key = mix(elements + U(int(low)) * _M2)
    return out


def sketch(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, as (sets, k) of 64-bit hashes. ``elements``: hashes of the elements of all sets, each at most
    once in a set; ``weights``: their real weights, at least LEAST_WEIGHT; ``owner``: each one's set. A set without elements gets zeros."""
    weights = np.asarray(weights, np.float64)
    if len(weights) and not weights.min() >= LEAST_WEIGHT:
        raise ValueError(f"weights must be at least {LEAST_WEIGHT}")
    rank = np.full(sets * k, np.inf)
    dart = np.zeros(sets * k, dtype=U)
    parts = _regions(elements, weights, owner)
    low, length, level = 0.0, FIRST, 0
    while parts:
        for width, keys, share, own in parts:
            h = mix(keys ^ mix(np.array([level + 1], dtype=U)))
            n = np.searchsorted(_poisson_steps(length * width), unit(h), side="right")
            thin = bool((share < 1).any())
            for j in range(int(n.max(initial=0))):
                hit = np.flatnonzero(n > j)
                d = mix(h[hit] + U(j + 1) * _STEP)
                if thin:
                    below = unit(mix(d ^ _M2)) < share[hit]
                    hit, d = hit[below], d[below]
                at = own[hit] * k + (mix(d) % U(k)).astype(np.int64)
                r = low + length * unit(mix(d ^ _M1))
                better = r < rank[at]
                at, r, d = at[better], r[better], d[better]
                order = np.lexsort((d, r, at))
                at, r, d = at[order], r[order], d[order]
                first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
                rank[at[first]], dart[at[first]] = r[first], d[first]
        low, level = low + length, level + 1
        length = min(low, LONGEST)
        open_sets = np.isinf(rank.reshape(sets, k)).any(axis=1)
        if not open_sets.any():
            break
        if not open_sets.all():
            still = [(w, open_sets[o], key, s, o) for w, key, s, o in parts]
            parts = [(w, key[m], s[m], o[m]) for w, m, key, s, o in still if m.any()]
    return dart.reshape(sets, k)


_WORD = Remembered(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 200_000)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's shingles of ``width`` words (lower case, split at white space), as often as they occur. A text of fewer
    words is one shingle; one without words has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=U)
    h = np.fromiter(map(_WORD.__getitem__, words), dtype=U, count=len(words))
    width = min(width, len(h))
    s = np.full(len(h) - width + 1, U(width), dtype=U)
    for i in range(width):
        s = mix(s * _STEP + h[i : len(h) - width + 1 + i])
    s.sort()
    return s


def _starts(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)


def shingle_weights(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text, and how often each occurs."""
    s = shingles(text, width)
    start = _starts(s)
    if len(start) == len(s):
        return s, np.ones(len(s))
    return s[start], np.diff(np.r_[start, len(s)]).astype(np.float64)


def shingle_cells(text: str | None, width: int = 5) -> np.ndarray:
    """A hash for each occurrence of a shingle: the o-th occurrence is a cell of its own, so the number of cells that two
    texts share is the sum of the lesser weights."""
    s = shingles(text, width)
    start = _starts(s)
    if len(start) == len(s):
        return s
    occurrence = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    more = occurrence > 0
    s[more] = mix(s[more] + occurrence[more].astype(U) * _M2)
    s.sort()
    return s


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of cells; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates, different between bands."""
    parts = sketches.reshape(len(sketches), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sketches), bands)).copy()
    for i in range(rows):
        out = mix(out * _STEP + parts[:, :, i])
    return out.view(np.int64)
