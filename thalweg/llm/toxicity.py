"""Operator 3: toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs, digit and sign substitutions, accents)
and matched by one Aho-Corasick automaton of the lexicon's entries and of
exception phrases. Entries are whole words and beginnings of words; a match
inside an exception phrase does not count, and of the entries that start at one
place the heaviest does. The sum of weights, normalised by length, becomes a
score between 0 and 1.

learn_lexicon() takes entries and weights (smoothed log-odds) from labelled
rows, MAX_TOXIC and MAX_CLEAN of them at most, in the order of a hash. That
bound is the only one: terms are counted and tested in Spark, and all that pass
are entries; they are at most as many as MAX_TOXIC texts hold, MIN_DOCS times
each. Every text is scored, whole.

One sure entry makes a text of common length toxic; in texts of some two hundred
thousand characters, where a match by chance is likelier, it takes a heavier
entry or two of them.

Defined results: a null or empty text scores 0; without toxic labels the lexicon
is empty and every score is 0; a doc_id labelled more than once is toxic if one
of its labels says so; repeated rows are scored each, and alike; of entries that
start at one place with equal weight the first met counts, which changes no
score; a text of any length is scored in one piece, in some five times its size
of a task's memory; other columns are kept by score(), whatever their names, but
for `toxicity`, which becomes the score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _minhash, _text

#: Labelled rows that the lexicon is learned from, at most.
MAX_TOXIC, MAX_CLEAN = 3000, 27000
MIN_DOCS = 3
THRESHOLD = 0.3
#: Share of toxic texts among the texts that an entry is in; an entry's weight for each unit of its log-odds; how much the
#: logarithm of a text's length takes from its weights. Of GRID the best mean F1 by cross_validated() over remainders 0, 1
#: and 3 (no row of remainder 2 had a part in it) of sf0.01, sf0.1 and check_s; of those within 0.001 the highest share.
MIN_PRECISION, WEIGHT, LENGTH = 0.5, 0.43, 0.35
GRID = ((0.3, 0.4, 0.5, 0.6, 0.7, 0.85), (0.35, 0.43, 0.52, 0.65, 0.8, 1.0), (0.0, 0.1, 0.2, 0.35))

# Look-alikes of Latin letters, and digits and signs that stand for letters.
CYRILLIC = dict(zip("авеёкмнорстухіїјѕһԁԛԝ", "abeekmhopctyxiijshdqw", strict=True))
GREEK = dict(zip("αβεηικνορτυχω", "abenikvoptuxw", strict=True))
SIGNS = dict(zip("0134578@$!|l", "oieastbasiii", strict=True))
# Phrases in which an entry is not meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "recycling trash", "clown fish", "class clown costume", "sore loser board", "stupid simple")

_WORD = re.compile(r"[^\W_]+")


def _table() -> dict[int, str]:
    table = {}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalpha():
            table[c] = SIGNS.get(base, base)
    for c in range(0xFF01, 0xFF5F):
        plain = chr(c - 0xFEE0).lower()
        table[c] = SIGNS.get(plain, plain)
    for zero_width in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF):
        table[zero_width] = ""
    return table | {ord(k): SIGNS.get(v, v) for k, v in (CYRILLIC | GREEK | SIGNS).items()}


_FOLD = _table()


def fold(text: str | None) -> str:
    return text.lower().translate(_FOLD) if text else ""


def terms(folded: str) -> set[str]:
    """Whole words ("=word") and their beginnings of 4 to 7 letters ("^beg")."""
    words = set(_WORD.findall(folded))
    return {f"={w}" for w in words if len(w) > 2} | {f"^{w[:n]}" for w in words for n in range(4, min(len(w), 8))}


class Matcher:
    """The automaton of a lexicon {term: weight} and of exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        entries: dict[str, list] = {}
        for term, weight in lexicon.items():
            entries.setdefault(term[1:], []).append((term[0], weight))
        for phrase in exceptions:
            entries.setdefault(fold(phrase), []).append(("!", 0.0))
        self.automaton = ahocorasick.Automaton()
        for text, kinds in entries.items():
            self.automaton.add_word(text, (len(text), kinds))
        self.automaton.make_automaton()

    def total(self, text: str | None) -> tuple[float, int]:
        """The sum of weights in a text, and the length of its folded form."""
        folded = fold(text)
        best: dict[int, tuple[float, int]] = {}
        shields = []
        for last, (length, kinds) in self.automaton.iter(folded):
            start, end = last + 1 - length, last + 1
            if start and folded[start - 1].isalnum():
                continue
            ends_word = end == len(folded) or not folded[end].isalnum()
            for kind, weight in kinds:
                if kind == "!":
                    shields += [(start, end)] if ends_word else []
                elif (kind == "^" or ends_word) and weight > best.get(start, (0, 0))[0]:
                    best[start] = (weight, end)
        return sum(w for s, (w, e) in best.items() if not any(a <= s and e <= b for a, b in shields)), len(folded)

    def score(self, text: str | None) -> float:
        total, size = self.total(text)
        # a long text needs more than a short one, by the logarithm of its length
        return 1 - math.exp(-0.25 * total / (1 + LENGTH * math.log1p(size / 1000))) if total else 0.0


def term_counts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, int, int]:
    """(term, a, b): in how many toxic and clean texts the terms are that MIN_DOCS toxic ones have; how many texts of each kind there are."""
    labels = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(picked[0].union(picked[1]))  # MAX_TOXIC + MAX_CLEAN rows at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(picked, "doc_id").select("toxic", "text").checkpoint()
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return None, 0, clean

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _text.pieces(batch.column(0)):
                _, prints, bounds = _minhash.shingles(data, offsets, 5, True)
                least = [int(prints[x:y].min() >> np.uint64(1)) if y > x else 0 for x, y in zip(bounds, bounds[1:], strict=False)]
                found = [terms(fold(text)) for text in batch.column(0).slice(first, end - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], ["origin", "terms"])

    def counted(kind: int) -> DataFrame:
        # near copies mostly share their least shingle, and so count as one text
        found = rows.filter(F.col("toxic") == kind).select("text").mapInArrow(emit, "origin bigint, terms array<string>")
        return found.select("origin", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n"))

    often = counted(1).filter(F.col("n") >= MIN_DOCS).select("term", F.col("n").alias("a")).checkpoint()
    if clean:
        both = often.join(counted(0).select("term", F.col("n").alias("b")), "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    else:
        both = often.withColumn("b", F.lit(0))
    return both, toxic, clean


def lexicon_of(both: DataFrame | None, toxic: int, clean: int, precision: float, weight: float) -> dict[str, float]:
    """Entries and weights from term_counts()."""
    if not toxic:
        return {}
    prior = toxic / (toxic + clean)
    expected = (F.col("a") + F.col("b")) * prior
    # so many toxic texts by chance: one such term in twenty lexicons is expected
    chance = F.col("a") * F.log(expected / F.col("a")) + (F.col("a") - expected)
    passed = both.filter((F.col("a") >= precision * (F.col("a") + F.col("b"))) & (chance < -math.log(20 * max(both.count(), 1))))
    sure = {r["term"]: (r["a"], r["b"]) for r in passed.collect()}
    return {t: round(weight * (math.log((sure[t][0] + 0.5) / (toxic + 1)) - math.log((sure[t][1] + 0.5) / (clean + 1))), 6) for t in _pruned(sure)}


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """{term: weight} from rows (doc_id, text) with labels (doc_id, toxic)."""
    return lexicon_of(*term_counts(docs, labels), MIN_PRECISION, WEIGHT)


def cross_validated(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], precisions: tuple[float, ...], weights: tuple[float, ...], lengths: tuple[float, ...]) -> dict[tuple[float, float, float], float]:
    """{(precision, weight, length): F1 at THRESHOLD}: each of `folds` is judged by a lexicon learned from the others; no other rows are looked at."""
    counts: dict[tuple[float, float, float], list[int]] = {}
    for fold_ in folds:
        found = term_counts(docs, labels.filter(fold_of().isin([f for f in folds if f != fold_])))
        found = (found[0].checkpoint() if found[0] is not None else None, *found[1:])
        judged = docs.join(F.broadcast(labels.filter("toxic in (0, 1)").filter(fold_of() == fold_)), "doc_id").select("toxic", "text")
        for precision in precisions:
            matcher_of = lexicon_of(*found, precision, 1.0)

            def totals(batches: Iterator[pa.RecordBatch], lexicon: dict = matcher_of) -> Iterator[pa.RecordBatch]:
                matcher = Matcher(lexicon)
                for batch in batches:
                    pairs = [matcher.total(t) for t in batch.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.int64())], ["toxic", "total", "size"])

            scored = judged.mapInArrow(totals, "toxic int, total double, size bigint").checkpoint()
            grid = [(w, n) for w in weights for n in lengths]
            hit = [F.expr(f"1 - exp(-0.25 * {w} * total / (1 + {n} * ln(1 + size / 1000))) >= {THRESHOLD}") for w, n in grid]
            sums = scored.agg(F.sum("toxic").alias("toxic"), *[F.count_if(h).alias(f"hit{i}") for i, h in enumerate(hit)], *[F.count_if(h & (F.col("toxic") == 1)).alias(f"right{i}") for i, h in enumerate(hit)]).first()
            for i, (w, n) in enumerate(grid):
                at = counts.setdefault((precision, w, n), [0, 0, 0])
                for k, v in enumerate((sums[f"right{i}"], sums[f"hit{i}"], sums["toxic"] or 0)):
                    at[k] += v
    return {k: 2 * right / max(hits + toxic, 1) for k, (right, hits, toxic) in counts.items()}


def _pruned(sure: dict[str, tuple[int, int]]) -> list[str]:
    """Entries {term: (toxic texts, clean texts)} without the beginnings that give way to a longer entry which says nearly as much and errs less."""
    by_text = sorted((t[1:], t) for t in sure)
    kept = []
    for t, (a, b) in sure.items():
        rival = False
        at = bisect_left(by_text, (t[1:], ""))
        while not rival and at < len(by_text) and by_text[at][0].startswith(t[1:]):
            u = by_text[at][1]
            rival = u != t and sure[u][0] >= 0.9 * a and sure[u][1] < b
            at += 1
        kept += [] if rival else [t]
    return sorted(kept)


def score(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """docs with a column toxicity."""
    kept = [c for c in docs.columns if c != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            scores = [matcher.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(scores, np.float64))], [*batch.schema.names, "toxicity"])

    docs = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", toxicity double"
    return docs.mapInArrow(run, schema)


def fold_of(doc_id: str = "doc_id"):
    """The fold of a document; fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary")) % 4


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of() != 2)
    held_out = F.coalesce(fold_of() == 2, F.lit(False))
    return score(docs, learn_lexicon(docs, labels)).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
