"""Operator 8: MinHash fingerprints of whole texts.

A fingerprint is PERMUTATIONS least hashes over shingles of five words, 16 bits
each, in hexadecimal. similar() joins bands of fingerprints in Spark and
confirms the Jaccard similarity of each candidate on the full sets: first with
the leader of each band, then, for who has no partner yet, with every smaller
doc_id of its bands that the numbers of shingles leave possible.

The edited text of a document needs its neighbour by doc_id. Documents are
dealt to ranges of doc_id between quantiles of that column alone; each range
also gets a copy of the one document that follows it, so one pass over sorted
ranges makes all edits, and the text is shuffled once.

Defined results: a null text is empty and has the fingerprint of no shingles;
rows without doc_id come after all others; rows that repeat a doc_id are ordered
by a hash of their text, and where they are very many dealt to several ranges by
it; rows equal in both lie in one range; a single row is its own neighbour; a
text of any length is taken whole, in some 30 times its size of a task's memory;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _minhash, _text
from .minhash_dedup import _alike, _plausible, _reachable, confirmed, shared_counts, shingle_sets

PERMUTATIONS = 64
SHINGLE = 5
BANDS = 16
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_rows(texts: pa.Array) -> np.ndarray:
    """(rows, PERMUTATIONS) uint16."""
    parts = [np.zeros((0, PERMUTATIONS), np.uint16)]
    for _, _, data, offsets in _text.pieces(texts):
        _, prints, bounds = _minhash.shingles(data, offsets, SHINGLE, False)
        parts.append(_minhash.signatures(prints, bounds, PERMUTATIONS))
    return np.concatenate(parts)


def as_text(prints: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in prints.astype(">u2")]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(fingerprint_rows(batch.column(1))))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(prints, "doc_id bigint, fingerprint string")


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, leader: each document that shares a fingerprint band with a smaller doc_id at a Jaccard of percent, and one such doc_id."""
    width = 4 * PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring("fingerprint", i * width + 1, F.lit(width))))
    rows = fingerprint(docs).filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.explode(bands).alias("band")).distinct()
    leaders = rows.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = rows.join(leaders.select("band", "leader"), "band").checkpoint()
    tried = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct().checkpoint()
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = shingle_sets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), SHINGLE).select("id", "n", "prints").dropDuplicates(["id"]).checkpoint()
    edges = confirmed(tried, sets, percent).checkpoint()

    # no leader is like them: their bands are searched in full, but for pairs that the bounds rule out
    sized = members.select("band", "id").join(sets.select("id", "n"), "id").join(shared_counts(sets), "id").filter(F.col("shared") * 100 >= F.col("n") * percent).checkpoint()
    rest = sized.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    other = sized.select("band", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("shared").alias("shared2"), F.col("words").alias("words2"))
    pairs = rest.join(other, "band").filter(F.col("id2") < F.col("id")).filter(_alike("n", "n2", percent)).filter(F.when(_plausible("n", "shared", "n2", "shared2", percent), _reachable("n", "words", "n2", "words2", percent)).otherwise(False))
    pairs = pairs.select(F.col("id2").alias("a"), F.col("id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return edges.union(confirmed(pairs, sets, percent)).groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("leader"))


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and then in order, each range with its ghost last."""
    held = None  # the last row, still without its neighbour
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            out = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[0] == b[0]]
            if out:
                yield _compared(out)
    # the last row of a task is a ghost


def _compared(pairs: list) -> pa.RecordBatch:
    texts = [a[2] or "" for a, _ in pairs]
    following = [b[2] or "" for _, b in pairs]
    edited = []
    for t, f in zip(texts, following, strict=True):
        cut = len(t) // 3
        edited.append(t[: len(t) - cut] + f[:cut])
    own, other, after = (fingerprint_rows(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[1] for a, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(as_text(own)),
            pa.array(as_text(other)),
            pa.array((own == other).mean(axis=1)),
            pa.array((own == after).mean(axis=1)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("bigint")
    # ascending in what follows: descending doc_id, rows without doc_id after all others
    docs = docs.select(F.bitwise_not(F.coalesce(doc_id, F.lit(-(1 << 63)))).alias("place"), doc_id.alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    if cuts is None:
        return docs.select(*(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in SCHEMA.split(", ")))).limit(0)
    cuts = F.split(F.lit(",".join(str(int(c)) for c in sorted(cuts))), ",").cast("array<bigint>")
    # a doc_id that many rows share is a cut several times over; its rows go to as many ranges, by tie
    shares = F.size(F.filter(cuts, lambda c: c == F.col("place")))
    step = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * shares), shares - 1)
    spread = docs.withColumn("part", (F.size(F.filter(cuts, lambda c: c < F.col("place"))) + F.greatest(step, F.lit(0))).cast("int"))
    # the first row of a range follows the last of the range before; the very first follows the very last
    heads = spread.groupBy("part").agg(F.min(F.struct("place", "tie")).alias("head")).orderBy("part").collect()  # as many rows as ranges
    ghosts = [(h["head"]["place"], h["head"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    ghosts = F.broadcast(spark.createDataFrame(ghosts, "place bigint, tie bigint, above int"))
    copies = F.filter(F.array(F.struct("part", F.lit(False).alias("ghost")), F.struct(F.col("above").alias("part"), F.lit(True).alias("ghost"))), lambda x: x["part"].isNotNull())
    rows = spread.join(ghosts, ["place", "tie"], "left").select("place", "tie", "doc_id", "text", F.explode(copies).alias("x")).select("x.part", "doc_id", "text", "x.ghost", "place", "tie")
    return rows.repartition("part").sortWithinPartitions("part", "ghost", "place", "tie").select("part", "doc_id", "text", "ghost").mapInArrow(_compare_neighbours, SCHEMA)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
