"""Operator 11: alignment of two tokenizers by a sweep over token ends.

Both tokenizers see the same bytes (a space and the text). The passes:

1. tokens become end events, packed: a row (document, side, first byte, ids) for
   each stretch of a text; an event's byte offset follows from the lengths of
   the ids before it;
2. the union of both sides is repartitioned by document and sorted within
   partitions by offset, and each partition is streamed through a machine whose
   state is the group that is open: where ends of A and B meet, a group closes,
   and all A-B pairs inside it are links. It emits chunks of documents with
   their groups, and for each chunk its pairs of ids and how many of its
   documents link them;
3. counts of pairs are summed over chunks (not over documents), the best of
   each A id is found, and every chunk gets back the counts of its own pairs.

Texts are encoded by units, a unit being a space and what follows it up to the
next space between two visible characters: no token of either tokenizer crosses
such a place (for B that is checked on its pieces; if one could, whole texts are
encoded), so units may be remembered, MEMO of them at a time.

Defined results: texts null, empty, or whose joined tokens differ from space and
text have no tokens; every row is a document of its own, so rows that repeat a
doc_id or a text count each; a null doc_id stays null; ties for the best of an
A id are all best; a text of any length is encoded in stretches of some STRETCH
characters, and its events swept block by block, so that a task holds its text,
its open group and its distinct pairs; a group of any size is counted by the
distinct ids in it where its pairs are many; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

TOKENIZERS = "/opt/tokenizers"
#: Characters of a text that are encoded together, about.
STRETCH = 1 << 19
#: Units remembered by a task, and code points of units.
MEMO, MEMO_CHARS = 400_000, 8_000_000
#: Tokens that the machine looks at together.
PIECE = 1 << 20
#: Links that are written out together; a group of more is counted by its distinct ids.
LINKS = 1 << 21
WIDE_GROUP = 1 << 12
#: (document, pair) entries of a chunk.
CHUNK = 1 << 22
A, B, NONE = 0, 1, 2

EVENTS = "key bigint, doc_id bigint, at bigint, side int, ids binary"
DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
CHUNKS = "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, pair array<bigint>, n_docs array<bigint>, entries array<int>, links binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

# a boundary has a visible character on both sides; U+180E is white space to some engines
_BETWEEN = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")


class Vocabulary:
    """The bytes of each id, flat, with n + 1 bounds."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.bounds = np.r_[0, np.cumsum(self.lengths)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.bounds[ids], self.lengths[ids])]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. (n of them) for each item, joined."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: {character: byte}."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Side A: a byte-level tokenizer file (JSON), fed with a space and the text."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        vocab, level = self.tokenizer.get_vocab(), _byte_level()
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)
        # a byte-level pattern never matches across a space between visible characters
        self.by_units = json.loads(spec).get("pre_tokenizer", {}).get("type") == "ByteLevel" and self.tokenizer.normalizer is None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 20_000):
            out += [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts[at : at + 20_000]], add_special_tokens=False)]
        return out


class PieceTokenizer:
    """Side B: a sentence piece model, which puts the space before the text itself."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces)])
        self.by_units = not any(re.search("[^▁]▁", t) for t in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Units:
    """The ids of every unit met so far, for both sides."""

    def __init__(self, sides: tuple) -> None:
        self.sides = sides
        self.split = all(s.by_units for s in sides)
        self.clear()

    def clear(self) -> None:
        self.chars, self.new = 0, []
        self.number = _Numbered(self.new)
        self.ok = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.bounds = [np.zeros(1, np.int64) for _ in self.sides]

    def look_up(self, units: list[str]) -> np.ndarray:
        """The number of each unit; what is new is encoded."""
        numbers = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        if self.new:
            want = [(" " + u).encode() for u in self.new]
            lengths = np.array([len(w) for w in want], np.int64)
            flat, ok = np.frombuffer(b"".join(want), np.uint8), np.ones(len(want), bool)
            for i, side in enumerate(self.sides):
                found = side.encode(self.new)
                n = np.array([len(f) for f in found], np.int64)
                ids = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
                have = side.vocabulary.bytes_of(ids)
                if len(have) != len(flat) or not np.array_equal(have, flat):
                    ends = np.r_[0, np.cumsum(side.vocabulary.lengths[ids])][np.r_[0, np.cumsum(n)]]
                    ok &= [have[a:b].tobytes() == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), want, strict=True)]
                self.ids[i] = np.concatenate([self.ids[i], ids])
                self.bounds[i] = np.concatenate([self.bounds[i], self.bounds[i][-1] + np.cumsum(n)])
            self.ok = np.concatenate([self.ok, ok])
            self.chars += int(lengths.sum())
            self.new.clear()
        return numbers

    def full(self) -> bool:
        return len(self.number) > MEMO or self.chars > MEMO_CHARS


class _Numbered(dict):
    def __init__(self, new: list[str]) -> None:
        self.new = new

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


def _stretches(text: str, split: bool) -> Iterator[str]:
    """text cut at places between units, about STRETCH characters each."""
    at = 0
    while split and len(text) - at > STRETCH and (m := _BETWEEN.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def _narrow(n_ids: int) -> type:
    return np.uint16 if n_ids <= 1 << 16 else np.int32


def _sides(spec: str, model: bytes) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(spec), PieceTokenizer(model)


def events(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Packed end events of docs (doc_id, text): key of the row, doc_id, first byte, side, ids. A document without tokens has one row of side NONE."""
    with open(a_file, encoding="utf-8") as f:
        spec = f.read()
    with open(b_file, "rb") as f:
        model = f.read()
    kept_as = [_narrow(len(s.vocabulary.lengths)) for s in _sides(spec, model)]

    def packed(rows: list[tuple], units: Units) -> pa.RecordBatch:
        """rows: (key, doc_id, stretches), all of a document or none."""
        split = [_BETWEEN.split(s) if units.split else [s] for _, _, stretches in rows for s in stretches]
        numbers = units.look_up(list(chain.from_iterable(split)))
        at_unit = np.r_[0, np.cumsum([len(s) for s in split], dtype=np.int64)]
        ok = units.ok[numbers]
        flats, bounds = [], []
        for i in range(len(units.sides)):
            n = np.diff(units.bounds[i])[numbers]
            flats.append(units.ids[i][ranges(units.bounds[i][numbers], n)])
            bounds.append(np.r_[0, np.cumsum(n)][at_unit])
        out, at = [], 0
        for key, doc_id, stretches in rows:
            first, at = at, at + len(stretches)
            if not stretches or not ok[at_unit[first] : at_unit[at]].all():
                out.append((key, doc_id, 0, NONE, b""))
                continue
            place = 0
            for s in range(first, at):
                found = [flat[x[s] : x[s + 1]] for flat, x in zip(flats, bounds, strict=True)]
                out += [(key, doc_id, place, i, ids.astype(kept_as[i]).tobytes()) for i, ids in enumerate(found)]
                if at - first > 1:
                    place += int(units.sides[A].vocabulary.lengths[found[A]].sum())
        kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_sides(spec, model))
        rows, chars = [], 0
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                rows.append((keys[i], ids[i], list(_stretches(text, units.split)) if text else []))
                chars += len(text or "")
                if chars > STRETCH:
                    yield packed(rows, units)
                    rows, chars = [], 0
                    if units.full():
                        units.clear()
        if rows:
            yield packed(rows, units)

    docs = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, EVENTS)


class Swept:
    """What a stretch of the sweep closed: ids of both sides in order, the group of each token, and per group its document and sizes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray) -> None:
        self.a, self.b, self.group_a, self.group_b, self.doc = a, b, group_a, group_b, doc
        self.n_a, self.n_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, A id << 32 | B id, times) of links, LINKS at a time; wide groups by distinct ids."""
        size = self.n_a * self.n_b
        start_a, start_b = np.r_[0, np.cumsum(self.n_a)], np.r_[0, np.cumsum(self.n_b)]
        for g in np.flatnonzero(size > WIDE_GROUP).tolist():
            x, nx = np.unique(self.a[start_a[g] : start_a[g + 1]], return_counts=True)
            y, ny = np.unique(self.b[start_b[g] : start_b[g + 1]], return_counts=True)
            step = max(1, LINKS // len(y))
            for at in range(0, len(x), step):
                pair = (x[at : at + step].astype(np.int64)[:, None] << 32 | y.astype(np.int64)).ravel()
                yield np.full(len(pair), self.doc[g]), pair, (nx[at : at + step].astype(np.int64)[:, None] * ny).ravel()
        size = np.where(size > WIDE_GROUP, 0, size)
        partners = np.where(size > 0, self.n_b, 0)[self.group_a]
        ends = np.cumsum(partners)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
            n = partners[at:end]
            if n.any():
                group = self.group_a[at:end]
                other = self.b[ranges(start_b[group], n)]
                pair = np.repeat(self.a[at:end].astype(np.int64) << 32, n) | other
                yield np.repeat(self.doc[group], n), pair, np.ones(len(pair), np.int64)
            at = end


class Machine:
    """Streams the events of documents in order; emit(document, Swept-derived values) once a document is over.

    Its state is the group that is open in the present document.
    """

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray, finish: Callable) -> None:
        self.lengths, self.finish = (lengths_a, lengths_b), finish
        self.docs: list = []
        self.parts: tuple[list, list] = ([], [])
        self.tokens, self.now, self.limit = 0, None, PIECE

    def add(self, key: int, doc_id: int | None, side: int, ids: np.ndarray) -> None:
        if key != self.now:
            if self.tokens >= self.limit:
                self.flush(False)
            self.now = key
            self.docs.append((key, doc_id))
        elif self.tokens >= self.limit:
            self.flush(True)
        if side != NONE:
            self.parts[side].append((len(self.docs) - 1, ids))
            self.tokens += len(ids)

    def flush(self, open_: bool = False) -> None:
        """Close what can be closed; with open_, the last document goes on."""
        ids, docs, ends = [], [], []
        for side in (A, B):
            parts = self.parts[side]
            ids.append(np.concatenate([p for _, p in parts]) if parts else np.zeros(0, np.int32))
            docs.append(np.repeat(np.array([d for d, _ in parts], np.int64), [len(p) for _, p in parts]))
            ends.append(np.cumsum(self.lengths[side][ids[side]]))
        most = max([int(e[-1]) for e in ends if len(e)], default=0)
        seen = np.zeros(most + 1, np.uint8)
        seen[ends[A]] = 1
        seen[ends[B]] += 2
        cuts = np.flatnonzero(seen == 3)
        groups = np.cumsum(seen == 3, dtype=np.int32)
        done = [int(np.searchsorted(e, cuts[-1], "right")) if len(cuts) else 0 for e in ends]
        closed = [(ids[s][: done[s]], groups[ends[s][: done[s]] - 1]) for s in (A, B)]
        doc = docs[A][np.searchsorted(ends[A], cuts)] if len(cuts) else np.zeros(0, np.int64)
        swept = Swept(closed[A][0], closed[B][0], closed[A][1], closed[B][1], doc)
        self.finish(self.docs, swept, open_)
        left = [ids[s][done[s] :] for s in (A, B)]
        self.docs = self.docs[-1:] if open_ else []
        self.parts = tuple([(0, x)] if open_ and len(x) else [] for x in left)
        self.tokens = sum(map(len, left)) if open_ else 0
        self.limit = max(PIECE, 2 * self.tokens)  # a wide open group isn't looked at again with every block
        if not open_:
            self.now = None


def _decimals(n: int, separators: bytes) -> np.ndarray:
    """[separator, id] -> the id's digits and the separator, padded with zeros."""
    digits = [str(i).encode() for i in range(n)]
    width = len(digits[-1]) + 1
    table = b"".join((d + bytes([s])).ljust(width, b"\0") for s in separators for d in digits)
    return np.frombuffer(table, np.uint8).reshape(len(separators), n, width)


class Digests:
    """Per document: counts of tokens, groups and links, digest of the groups, distinct pairs; emitted in chunks."""

    def __init__(self, n_ids: tuple[int, int]) -> None:
        self.tables = _decimals(n_ids[A], b",|"), _decimals(n_ids[B], b",;")
        self.out: list[pa.RecordBatch] = []
        self.carried: dict | None = None
        self._new_chunk()

    def _new_chunk(self) -> None:
        self.rows, self.pairs, self.times, self.size, self.chunk = [], [], [], 0, None

    def text(self, swept: Swept) -> tuple[np.ndarray, np.ndarray]:
        """Groups as `a1,a2|b1;` one after the other, and their n + 1 bounds."""
        n, starts = swept.n_a + swept.n_b, np.r_[0, np.cumsum(swept.n_a + swept.n_b)]
        width = max(t.shape[2] for t in self.tables)
        cells = np.zeros((int(n.sum()), width), np.uint8)
        for ids, group, count, before, table in ((swept.a, swept.group_a, swept.n_a, 0, self.tables[A]), (swept.b, swept.group_b, swept.n_b, swept.n_a, self.tables[B])):
            first = np.cumsum(count) - count
            nth = np.arange(len(ids)) - first[group]
            place = starts[group] + nth + (before if isinstance(before, int) else before[group])
            cells[place, : table.shape[2]] = table[(nth == count[group] - 1).astype(np.int8), ids]
        used = cells != 0
        lengths = np.r_[0, np.cumsum(np.count_nonzero(used, axis=1))]
        return cells[used], lengths[starts]

    def finish(self, docs: list, swept: Swept, open_: bool) -> None:
        flat, at = self.text(swept)
        bounds = np.searchsorted(swept.doc, np.arange(len(docs) + 1))
        sums = [np.r_[0, np.cumsum(x)][bounds] for x in (swept.n_a, swept.n_b, np.ones(len(swept.doc), np.int64), swept.n_a * swept.n_b)]
        found = [_summed(d, p, t) for d, p, t in swept.links()]
        if len(found) > 1:
            found = [_summed(*(np.concatenate([f[i] for f in found]) for i in range(3)))]
        doc, pair, times = found[0] if found else (np.zeros(0, np.int64),) * 3
        ends = np.searchsorted(doc, np.arange(len(docs) + 1))
        for i, (key, doc_id) in enumerate(docs):
            state = self.carried if i == 0 and self.carried else {"n": [0, 0, 0, 0], "hash": hashlib.sha256(), "pairs": [], "any": False}
            self.carried = None
            last = open_ and i == len(docs) - 1
            state["n"] = [x + int(s[i + 1] - s[i]) for x, s in zip(state["n"], sums, strict=True)]
            text = flat[at[bounds[i]] : at[bounds[i + 1]]]
            if len(text):
                # the separator after a group goes before the next
                state["hash"].update((b";" if state["any"] else b"") + text[:-1].tobytes())
                state["any"] = True
            if ends[i + 1] > ends[i]:
                state["pairs"].append((pair[ends[i] : ends[i + 1]], times[ends[i] : ends[i + 1]]))
            if last:
                self.carried = state
            else:
                self._over(key, doc_id, state)

    def _over(self, key: int, doc_id: int | None, state: dict) -> None:
        if len(state["pairs"]) > 1:
            pair, times = (np.concatenate([p[i] for p in state["pairs"]]) for i in (0, 1))
            _, pair, times = _summed(np.zeros(len(pair), np.int64), pair, times)
            state["pairs"] = [(pair, times)]
        pair, times = state["pairs"][0] if state["pairs"] else (np.zeros(0, np.int64),) * 2
        if self.chunk is None:
            self.chunk = key
        self.rows.append((doc_id, *state["n"], state["hash"].hexdigest() if state["any"] else ""))
        self.pairs.append(pair)
        self.times.append(times)
        self.size += len(pair)
        if self.size >= CHUNK:
            self.end_chunk()

    def end_chunk(self) -> None:
        if self.chunk is None:
            return
        pair, place, n_docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        times = np.concatenate(self.times)
        cols = dict(zip((*DOCS, "groups_sha256"), map(list, zip(*self.rows, strict=True)), strict=True))
        links = pa.compress(place.astype(np.int32).tobytes() + times.tobytes(), codec="zstd", asbytes=True)
        entries = np.array([len(p) for p in self.pairs], np.int32)
        one = {"chunk": self.chunk, **cols, "pair": pair, "n_docs": n_docs.astype(np.int64), "entries": entries, "links": links}
        schema = pa.schema([("chunk", pa.int64()), *[(k, pa.list_(pa.int64())) for k in DOCS], ("groups_sha256", pa.list_(pa.string())), ("pair", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())), ("entries", pa.list_(pa.int32())), ("links", pa.binary())])
        self.out.append(pa.RecordBatch.from_arrays([pa.array([one[f.name]], f.type) for f in schema], schema=schema))
        self._new_chunk()

    def take(self) -> list[pa.RecordBatch]:
        out, self.out = self.out, []
        return out


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair), sorted, and the sum of their times."""
    if not len(doc):
        return doc, pair, times
    low = (pair >> 32) << 16 | (pair & 0xFFFFFFFF)
    if int(pair.max() >> 32) < 1 << 16 and int((pair & 0xFFFFFFFF).max()) < 1 << 16 and int(doc.max()) < 1 << 31:
        key = (doc.astype(np.int64) << 32) | low
        if len(times) and times.max() == 1:
            key.sort()
            order = None
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.diff(np.r_[heads, len(key)]) if order is None else np.add.reduceat(times[order], heads)
        key = key[heads]
        return key >> 32, ((key >> 16) & 0xFFFF) << 32 | (key & 0xFFFF), total
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])
    return doc[heads], pair[heads], np.add.reduceat(times[order], heads)


def _lengths(a_file: str, b_file: str) -> tuple[np.ndarray, np.ndarray]:
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        return tuple(s.vocabulary.lengths for s in _sides(f.read(), g.read()))


def _swept(found: DataFrame, lengths: tuple[np.ndarray, np.ndarray], collector: Callable, schema: str) -> DataFrame:
    """The machine over events, partition by partition; collector() has finish(), take() and end_chunk()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = collector()
        machine, kept_as = Machine(*lengths, into.finish), [*(_narrow(len(x)) for x in lengths), np.int32]
        for batch in batches:
            keys, doc_ids, sides = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for key, doc_id, side, ids in zip(keys, doc_ids, sides, batch.column(4), strict=True):
                machine.add(key, doc_id, side, np.frombuffer(ids.as_py(), kept_as[side]))
                yield from into.take()
        machine.flush()
        into.end_chunk()
        yield from into.take()

    by_offset = found.repartition("key").sortWithinPartitions("key", "at", "side")
    return by_offset.mapInArrow(run, schema)


class Groups:
    """Per document its groups, as arrays; the output of align()."""

    SCHEMA = "key bigint, doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.carried: list = [[], [], [], []]

    def finish(self, docs: list, swept: Swept, open_: bool) -> None:
        bounds = np.searchsorted(swept.doc, np.arange(len(docs) + 1))
        ends = [np.r_[0, np.cumsum(n)] for n in (swept.n_a, swept.n_b)]
        for i, (key, doc_id) in enumerate(docs):
            lo, hi = bounds[i], bounds[i + 1]
            for j, (ids, e) in enumerate(zip((swept.a, swept.b), ends, strict=True)):
                self.carried[j + 2] += (e[lo + 1 : hi + 1] - e[lo] + len(self.carried[j])).tolist()
                self.carried[j] += ids[e[lo] : e[hi]].tolist()
            if not (open_ and i == len(docs) - 1):
                self.rows.append((key, doc_id, *self.carried))
                self.carried = [[], [], [], []]

    def end_chunk(self) -> None:
        pass

    def take(self) -> list[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        ints = pa.list_(pa.int32())
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("a_ids", ints), ("b_ids", ints), ("a_ends", ints), ("b_ends", ints)])
        return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)] if rows else []


def align(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """For each row of docs (doc_id, text): key of the row, doc_id, ids of both sides, and after how many tokens of each side every group ends."""
    return _swept(events(docs, a_file, b_file), _lengths(a_file, b_file), Groups, Groups.SCHEMA)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair of ids is linked, and whether no other pair of its A id is in more."""
    counts = chunks.select(F.explode(F.arrays_zip("pair", "n_docs")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n_docs").alias("count"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(best), F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Counts of each document's alignment, and how common its links are in the corpus (RESULT)."""
    lengths = _lengths(a_file, b_file)
    n_ids = tuple(map(len, lengths))
    chunks = _swept(events(docs, a_file, b_file), lengths, lambda: Digests(n_ids), CHUNKS)
    chunks = shared.written(chunks, "alignment")
    counts = pair_counts(chunks)
    back = chunks.select("chunk", F.explode("pair").alias("pair")).join(counts, "pair").groupBy("chunk")
    back = back.agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("counts"))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                entries = row["entries"].values.to_numpy()
                found = row["counts"].values
                n = int(entries.sum())
                sums = [np.zeros(len(entries), np.int64)] * 2
                if n:
                    raw = pa.decompress(row["links"].as_buffer(), decompressed_size=12 * n, codec="zstd")
                    place, times = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int64, n, 4 * n)
                    count = found.field("count").to_numpy()
                    best = found.field("best").to_numpy(zero_copy_only=False)
                    at = np.r_[0, np.cumsum(entries)]
                    sums = [np.diff(np.r_[0, np.cumsum(x)][at]) for x in (np.where(best[place], times, 0), count[place] * times)]
                cols = [row[k].values for k in DOCS] + [pa.array(s, pa.int64()) for s in sums] + [row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(cols, [*DOCS, "n_best", "count_sum", "groups_sha256"])

    return chunks.drop("pair", "n_docs").join(back, "chunk", "left").mapInArrow(looked_up, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
