"""Operator 12: grouping of spelling variants by forward and reversed sorted dictionaries.

One edit leaves a half intact: two words that differ by one inserted, deleted or
replaced code point share the first half of the shorter one or its last half. So
each word stands in blocks (s, a, b): s is the length of the shorter word of the
pairs looked for there (the word's own length or one less), a and b are how many
code points at the start and at the end its members share. Blocks of shared
starts are ranges of the sorted dictionary, blocks of shared ends are ranges of
the dictionary sorted by reversed words. A block of more than SPLIT words is
subdivided: the edit is in one half of what its members do not share, so the
block becomes one with a longer start and one with a longer end; at last one
code point is left, and such a block's size is bounded by the alphabet. A pair
whose words part after p code points belongs to the one block that p falls in,
so each pair is found once. Blocks are dealt in ranges of the dictionary and
scanned in order; each neighbour is verified, and what is sent on is how many
near words a word has in a block and which is the most frequent.

A word's form is its most frequent near word if that is RATIO times as frequent;
roots are found by doubling, in so many joins as the logarithm of the longest
possible chain (each step multiplies the frequency by RATIO).

Defined results: a null text has no words; a null doc_id counts as an empty one;
rows that repeat count each; of near words of equal frequency the smallest in
code-point order is the form; texts are read in stretches of some STRETCH code
points, cut where no word is, so any length will do; words may have any length;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run of a document in so many loses a code point.
NOISE = 199
#: Words of a block that are compared with each other.
SPLIT = 48
STRETCH = 1 << 20
#: Distinct words, and code points of text, after which a task sends its counts.
HELD, HELD_CHARS = 300_000, 1 << 26
#: Longer words are compared by a plain loop.
WIDE = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
_OTHER = re.compile(f"[^{LETTERS}]")

FOUND = "word string, n_near bigint, form string, form_n bigint"


def runs(text: str) -> Iterator[list[str]]:
    """Lower-cased maximal runs of letters, of LEAST_LENGTH or more, a list for each stretch."""
    text = text.encode().translate(_LOWER).decode()
    at = 0
    while len(text) - at > STRETCH and (m := _OTHER.search(text, at + STRETCH)):
        yield _RUN.findall(text[at : m.start()])
        at = m.end()
    yield _RUN.findall(text[at:] if at else text)


def thinned(doc_id: int | None, found: list[str]) -> dict[str, str | None]:
    """The runs of a document that lose a code point, with what they become (None: too short to count)."""
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: dict[str, str | None] = {}
    for run in set(found):
        h = crc32(run.encode(), prefix)
        if not h % NOISE:
            at = h % len(run)
            out[run] = run[:at] + run[at + 1 :] if len(run) > LEAST_LENGTH else None
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): words with LEAST_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chars = Counter(), 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for found in runs(text):
                    total.update(found)
                    if gone := thinned(doc_id, found):
                        for w, n in Counter(w for w in found if w in gone).items():
                            total[w] -= n
                            if gone[w] is not None:
                                total[gone[w]] += n
                    chars += len(text)
                    if len(total) > HELD or chars > HELD_CHARS:
                        yield sent()
                        total, chars = Counter(), 0
        yield sent()

    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _key() -> F.Column:
    """A block's place in the forward or the reversed dictionary."""
    return F.concat_ws(" ", "s", "a", "b", F.expr("left(word, a)"), F.expr("reverse(right(word, b))"))


def _halves(a: str, b: str) -> F.Column:
    """The two blocks that a word of block (s, a, b) stands in next: a longer start, or a longer end."""
    mid = f"{a} + (s - {a} - {b}) div 2"
    return F.expr(f"array(struct(cast({mid} as int) a, cast({b} as int) b), struct(cast({a} as int) a, cast(s - ({mid}) as int) b))")


def blocks(words: DataFrame) -> DataFrame:
    """words (word, n) in the blocks (key, s, a, b) where they are compared."""
    long = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(long, long - 1)).alias("s")).filter("s > 0")
    rows = rows.select("word", "n", "s", F.explode(_halves("0", "0")).alias("x")).select("word", "n", "s", "x.*")
    done = None
    while True:
        rows = rows.withColumn("key", _key())
        # a block without a word of length s has no pairs
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("s")).alias("short")).filter("size > 1 and short > 0").select("key", "size")
        rows = shared.written(rows.join(sizes, "key"), "blocks")
        large = (F.col("size") > SPLIT) & F.expr("s - a - b > 1")
        small = rows.filter(~large).drop("size")
        done = small if done is None else done.union(small)
        rows = rows.filter(large)
        if rows.isEmpty():
            return done
        rows = rows.select("word", "n", "s", F.explode(_halves("a", "b")).alias("x")).select("word", "n", "s", "x.*")


def shared_ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many first columns two rows agree, row by row; they differ somewhere."""
    return np.argmin(x == y, axis=1)


def _plain_ends(x: bytes, y: bytes) -> tuple[int, int]:
    most = min(len(x), len(y))
    start = next((i for i in range(most) if x[i] != y[i]), most)
    end = next((i for i in range(most) if x[-1 - i] != y[-1 - i]), most)
    return start, end


class Scan:
    """Compares the words of whole blocks, sorted by block, then length, then word."""

    def __init__(self, key: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, words: list[bytes], n: np.ndarray) -> None:
        self.s, self.a, self.b, self.words, self.n = s, a, b, words, n
        self.size = np.array([len(w) for w in words], np.int64)
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.end = np.repeat(np.r_[heads[1:], len(key)], np.diff(np.r_[heads, len(key)]))
        width = int(min(self.size.max(), WIDE)) + 1
        cut = [w if len(w) <= WIDE else b"" for w in words]
        self.forward = np.array(cut, f"S{width}").view(np.uint8).reshape(len(words), width)
        self.backward = np.array([w[::-1] for w in cut], f"S{width}").view(np.uint8).reshape(len(words), width)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        start, end = shared_ends(self.forward[i], self.forward[j]), shared_ends(self.backward[i], self.backward[j])
        for k in np.flatnonzero((self.size[i] > WIDE) | (self.size[j] > WIDE)).tolist():
            start[k], end[k] = _plain_ends(self.words[i[k]], self.words[j[k]])
        s, low, b = self.s[i], self.a[i], self.b[i]
        one_edit = np.where(self.size[i] == self.size[j], start + end >= s - 1, start + end >= s)
        return one_edit & (start >= low) & ((b == 0) | (start < s - b))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Near words (i, j) of one block, each pair once; i has the block's shorter length."""
        found = [(np.zeros(0, np.int64),) * 2]
        at = np.flatnonzero(self.size == self.s)
        step = 1
        while len(at := at[self.end[at] > at + step]):
            ok = self.near(at, at + step)
            found.append((at[ok], at[ok] + step))
            step += 1
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def found(self) -> pa.RecordBatch:
        """FOUND: for each word of a block that has near ones there."""
        i, j = self.pairs()
        i, j = np.r_[i, j], np.r_[j, i]
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[j], -self.n[j], i))
        i, j = i[order], j[order]
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        of = [self.words[k].decode("latin-1") for k in i[heads].tolist()]
        form = [self.words[k].decode("latin-1") for k in j[heads].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(np.diff(np.r_[heads, len(i)]).astype(np.int64)), pa.array(form, pa.string()), pa.array(self.n[j[heads]])], ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame) -> DataFrame:
    """For each of words (word, n) that has near ones: n_near, form (the most frequent near one), form_n."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = table["key"][-1].as_py()
            # the last block may go on in the next batch
            keys = table["key"].to_numpy()
            whole = len(keys)
            while whole and keys[whole - 1] == last:
                whole -= 1
            if whole:
                yield scanned(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield scanned(pa.Table.from_batches(held))

    def scanned(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        s, a, b, n = (table[c].to_numpy().astype(np.int64) for c in ("s", "a", "b", "n"))
        return Scan(key, s, a, b, [w.encode("latin-1") for w in table["word"].to_pylist()], n).found()

    dealt = blocks(words).select("key", "s", "a", "b", "word", "n")
    # equal keys stay together in range partitioning; no block is larger than SPLIT or what the alphabet allows
    dealt = dealt.repartitionByRange("key").sortWithinPartitions("key", F.length("word"), "word")
    found = dealt.mapInArrow(scan, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("neg"), "form")).alias("x"))
    return found.select("word", "n_near", F.col("x.form").alias("form"), (-F.col("x.neg")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of forms (word, form), where counts of at most `most` grow RATIO-fold with each step."""
    longest = max(1, math.floor(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, RATIO) + 1e-9) + 1)
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        up = shared.written(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root")), "roots")
    return up


def variants(words: DataFrame) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n."""
    words = words.select("word", "n")
    every = shared.written(words.join(near_words(words), "word", "left"), "variants")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    every = every.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))
    most = every.agg(F.max("n").alias("n")).first()["n"] or 0
    up = roots(every.filter("form is not null"), most)
    return every.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(shared.written(counted(docs), "words"))
