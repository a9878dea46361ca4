"""Operator 1: suffix-array dedup with a logarithmic family of indexes.

A suffix array here is sparse (it holds suffixes at the anchors of
_windows.py, so that every window is reached from one of them) and orders
suffixes by fingerprints of their prefixes instead of by letters: equal
prefixes are neighbours in either order, and that is all a merge-scan reads.

Suffix space is dealt into buckets. In each, batches arrive one after the
other; a batch is sorted into a suffix array and enters the family, where two
levels of like size are merge-scanned and become the next level. A scan finds
the suffixes whose whole run was seen earlier, and those that share a prefix
but differ further on; the latter are compared byte by byte.

Defined results: a null text is empty; rows without doc_id take part in no
match and are returned whole; rows that repeat a doc_id and its text are one
document, whose decisions hold for each of the rows; unlike texts of one doc_id
are documents of their own, in the order of a fingerprint; of equal strings the
one that starts first stays; a text of any length is worked on in stretches of a
million bytes, at some twenty times its size of a task's memory in all; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text, _windows

WINDOW = 100
GRAM = 32
#: Batches in which the windows of a slice of open runs enter their family.
BATCHES = 4
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class SuffixLevels:
    """Sorted runs in levels of geometrically growing size; add() yields what is known to be a later copy."""

    def __init__(self) -> None:
        self.levels: list[_windows.Runs] = []

    def add(self, batch: _windows.Runs) -> list[_windows.Runs]:
        level, later = _windows.settle(_windows.sort_runs(batch))
        found = [later]
        while self.levels and len(self.levels[-1]["gram"]) <= 2 * len(level["gram"]):
            level, later = self._merge_scan(self.levels.pop(), level)
            found.append(later)
        self.levels.append(level)
        return found

    def finish(self) -> tuple[_windows.Runs, list[_windows.Runs]]:
        """The whole index, and the last later copies."""
        found = []
        while len(self.levels) > 1:
            level, later = self._merge_scan(self.levels.pop(), self.levels.pop())
            self.levels.append(level)
            found.append(later)
        return self.levels[0], found

    @staticmethod
    def _merge_scan(a: _windows.Runs, b: _windows.Runs) -> tuple[_windows.Runs, _windows.Runs]:
        return _windows.settle(_windows.sort_runs(_windows.concat([a, b])))


def _bucket(table: pa.Table, frequent: np.ndarray) -> pa.Table:
    family, out = SuffixLevels(), []
    for batch in _windows.batches_of(table):
        out.append((batch.pop("done"), _windows.SETTLED))
        out += [(x, _windows.SETTLED) for x in family.add(batch)]
    index, later = family.finish()
    out += [(x, _windows.SETTLED) for x in later]
    return _windows.marks([*out, _windows.open_runs(index, frequent)])


def _cut(data, offsets, rows, start, n) -> list[bytes]:
    raw, lo = data.tobytes(), offsets[rows] + start
    return [raw[a:b] for a, b in zip(lo.tolist(), (lo + n - 1 + WINDOW).tolist(), strict=True)]


def _compare(table: pa.Table) -> pa.Table:
    """Of windows in open runs, those with an earlier equal: single windows enter a family of their own, document by document."""
    found = [{"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64)}]
    gram = table["gram"].to_numpy()
    at = 0
    while at < len(gram):
        # enough whole grams for a slice of numpy work
        end = min(len(gram), at + 20_000)
        end = int(np.searchsorted(gram, gram[end - 1], "right"))
        part = table.slice(at, end - at)
        at = end
        n = part["n"].to_numpy().astype(np.int64)
        data, offsets = np.frombuffer(b"".join(part["body"].to_pylist()), np.uint8), np.r_[0, np.cumsum(n - 1 + WINDOW)]
        prefix = _text.prefix_hash(_text.BYTE_CODES[data])
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        lo = offsets[row] + off
        prints = _text.span_hash(prefix, lo, lo + WINDOW)
        doc, place = part["doc_id"].to_numpy()[row], part["start"].to_numpy().astype(np.int64)[row] + off
        ones = np.ones(len(row), np.int32)
        windows = {"gram": prints, "body": _text.mix(prints), "doc": doc, "start": place, "n": ones, "copies": ones}
        family, order = SuffixLevels(), np.argsort(doc, kind="stable")
        for batch in np.array_split(order, BATCHES):
            found += family.add({k: v[batch] for k, v in windows.items()})
        found += family.finish()[1]
    return _windows.spans_table(*(np.concatenate([x[k] for x in found]) for k in ("doc", "start")))


def _finish(doc_id, data, start, n, schema_only=False):
    if schema_only:
        return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    gone = _windows.covered(len(data), WINDOW, start, n) if len(start) else np.zeros(len(data), bool)
    return {"doc_id": doc_id, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])), "kept_sha256": hashlib.sha256(data[~gone].tobytes() if len(start) else data).hexdigest()}


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove each byte in a 100-byte string that also starts earlier: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _windows.repeats(docs, _windows.byte_tokens, WINDOW, GRAM, False, _bucket, _compare, _cut, _finish, SCHEMA)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
