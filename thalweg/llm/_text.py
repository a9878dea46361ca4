"""Vectorised helpers over Arrow text columns: byte buffers, word spans, fingerprints.

Everything works on a few hundred kilobytes of text at a time, so that the
temporary arrays of a task stay small whatever the batch size of the session.
A null text is an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
#: Words of more bytes have their fingerprint from a digest.
LONG_WORD = 64

#: The bytes that part words: space and \x09-\x0D.
_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, a bijection of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, their offsets from 0) for runs of rows of about `size` bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`, and the n + 1 bounds of each row's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = _INK[data]
    before = np.zeros(n + 1, bool)
    before[1:] = ink
    before[offsets] = False  # a row's first byte has nothing before it
    after = np.zeros(n + 1, bool)
    after[:n] = ink
    after[offsets] = False
    starts = np.flatnonzero(ink & ~before[:n])
    ends = np.flatnonzero(ink & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() reads the hash of any span of `codes`."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_tables(len(codes))[0][: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span, by content and length alone."""
    inverse = _power_tables(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of words, PIECE_BYTES of text at a time.

    A polynomial modulo 2^64 has known collisions between some very long words; those get a digest.
    """
    out = np.empty(len(starts), np.uint64)
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    at = 0
    while at < len(short):
        lo = starts[short[at]]
        end = int(np.searchsorted(starts[short], lo + PIECE_BYTES))
        some = short[at:end]
        prefix = prefix_hash(BYTE_CODES[data[lo : ends[some[-1]]]])
        out[some] = span_hash(prefix, starts[some] - lo, ends[some] - lo)
        at = end
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from n + 1 bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
