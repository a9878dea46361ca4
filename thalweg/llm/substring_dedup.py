"""Operator 4: substring dedup by suffix automata and matching statistics.

The reference is the corpus itself, which has no size bound, so its shards are
not broadcast: a shuffle deals the open runs of _windows.py by anchor k-gram,
and a shard is the runs of one k-gram. Each shard gets a suffix automaton over
word fingerprints with the number of places where each state ends; the runs are
then streamed through it, and wherever the longest match has the window's
length or more and its state more than one place, the window is a repeat. The
few k-grams with more texts than a shard takes are counted by the fingerprints
of their windows instead, spread over all tasks.

Defined results: a null text has no words; rows without doc_id take part in no
match and are returned whole; rows that repeat a doc_id and its text are one
document, whose decisions hold for each of the rows; unlike texts of one doc_id
are documents of their own; of equal windows none stays; a text of any
length is worked on in stretches of a million words, at some thirty times its
size of a task's memory in all; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text, _windows

WINDOW = 35
GRAM = 12
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class SuffixAutomaton:
    """Of several sequences, with the number of places where each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.len) - 1

    def _split(self, p: int, token, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, weight: int = 1) -> None:
        last = 0
        for token in sequence:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, token, q)
            else:
                new, p = self._state(self.len[last] + 1, 0, {}), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, token, q)
                last = new
            self.places[last] += weight

    def count_places(self) -> None:
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]

    def repeated_ends(self, sequence: list, length: int) -> list[int]:
        """Ends in `sequence` of windows of `length` tokens that have more than one place, by matching statistics."""
        state, matched, out = 0, 0, []
        for i, token in enumerate(sequence):
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if token in self.next[state]:
                state, matched = self.next[state][token], matched + 1
            while state and self.len[self.link[state]] >= length:
                state = self.link[state]
                matched = self.len[state]
            if matched >= length and self.places[state] > 1:
                out.append(i + 1)
        return out


def _bucket(table: pa.Table, frequent: np.ndarray) -> pa.Table:
    out, live = [], []
    for batch in _windows.batches_of(table):
        out.append((batch.pop("done"), _windows.SETTLED))
        live.append(batch)
    kept, others = _windows.settle(_windows.sort_runs(_windows.concat(live)))
    several = kept["copies"] > 1
    out += [(others, _windows.SETTLED), ({k: v[several] for k, v in kept.items()}, _windows.SETTLED), _windows.open_runs(kept, frequent)]
    return _windows.marks(out)


def _cut(data, offsets, rows, start, n) -> list[bytes]:
    starts, ends, bounds = _text.words(data, offsets)
    raw, lo = data.tobytes(), bounds[rows] + start
    return [raw[a:b] for a, b in zip(starts[lo].tolist(), ends[lo + n - 2 + WINDOW].tolist(), strict=True)]


def _compare(table: pa.Table) -> pa.Table:
    docs, places = [], []
    for shard in _windows.by_gram(table):
        doc, start = shard["doc_id"].to_pylist(), shard["start"].to_pylist()
        bodies = [x.split() for x in shard["body"].to_pylist()]
        automaton = SuffixAutomaton()
        for x in bodies:
            automaton.add(x)
        automaton.count_places()
        for d, s, x in zip(doc, start, bodies, strict=True):
            ends = automaton.repeated_ends(x, WINDOW)
            docs += [d] * len(ends)
            places += [s + e - WINDOW for e in ends]
    return _windows.spans_table(np.array(docs, np.int64), np.array(places, np.int64))


def _finish(doc_id, data, start, n, schema_only=False):
    if schema_only:
        return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    words, gone = data.tobytes().split(), 0
    if len(start):
        cover = _windows.covered(len(words), WINDOW, start, n)
        gone, kept = int(cover.sum()), [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
    else:
        kept = words
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": gone, "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Remove each word in a 35-word window that also starts elsewhere: doc_id, n_words, n_removed, kept_sha256."""
    return _windows.repeats(docs, _windows.word_tokens, WINDOW, GRAM, True, _bucket, _compare, _cut, _finish, SCHEMA)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
