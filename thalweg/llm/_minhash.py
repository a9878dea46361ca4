"""Word shingles and MinHash signatures of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from . import _text


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) sorted, each once; and the n + 1 bounds of each row's shingles.

    A row's shingles are the fingerprints of `size` words in a row; of fewer
    words, the whole sequence; of no words, none. fold: A-Z count as a-z.
    """
    if fold:
        data = _text.lower(data)
    starts, ends, bounds = _text.words(data, offsets)
    prefix = _text.prefix_hash(_text.word_hashes(data, starts, ends))
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    prints = _text.span_hash(prefix, first, first + np.minimum(n, size)[row])
    order = np.lexsort((prints, row))
    row, prints = row[order], prints[order]
    once = np.r_[True, (np.diff(row) != 0) | (np.diff(prints) != 0)] if len(row) else np.zeros(0, bool)
    row, prints = row[once], prints[once]
    return row, prints, np.searchsorted(row, np.arange(len(n) + 1))


def multipliers(permutations: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of the universal hashes x -> a * x + b modulo 2^64, of which the upper half counts."""
    x = _text.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x[:permutations] | np.uint64(1), x[permutations:]


def signatures(prints: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """(rows, permutations) uint16: the low bits of each least hash; 65535 for a row without shingles."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(bounds) - 1, permutations), 0xFFFF, np.uint16)
    if len(full):
        heads = bounds[full]
        for j, (a, b) in enumerate(zip(*multipliers(permutations, seed), strict=True)):
            least = np.minimum.reduceat((prints * a + b) >> np.uint64(32), heads)
            out[full, j] = (_text.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out
