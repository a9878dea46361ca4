"""Operator 5: MinHash near-dedup by a multi-index Hamming join.

A signature is CHUNKS x WIDTH values of 16 bits. Two signatures that differ in
fewer than CHUNKS * (ERRORS + 1) values have, by the pigeonhole principle, a
chunk with at most ERRORS differing values; so each chunk is indexed under the
keys that leave out ERRORS of its values, every combination, and no pair under
that distance is missed. At a Jaccard similarity of exactly 0.8 a pair is lost
with probability 1.6e-6, above it with less. Every candidate is confirmed on
the full shingle sets.

Equal sets become one class first. In each key the members are compared with
one leader, then with the most central member; only pairs that are then still in
different components are compared with each other, and of those only the ones
whose numbers of shared shingles leave the similarity possible. So a large group
of copies costs two comparisons a member, and heavily edited copies none.

Defined results: a null text is empty; an empty set is linked with nothing;
rows without doc_id take no part, have no component and are kept; rows that
repeat a doc_id are judged each by its own text, so equal ones share a result
and unlike ones need not; of equally central leaders the largest id leads, of
equal sets the smallest doc_id stands for all; a text of any length is one set,
in some 30 times its size of a task's memory; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph, _minhash, _text

CHUNKS, WIDTH, ERRORS = 10, 5, 1
#: In shared_counts(), in place of an id: several sets have it.
SEVERAL = -(1 << 63)
#: Classes of shingles, by their upper bits, in which shared_counts() counts.
CLASSES = 64
#: A class's count stands as that many bits, one in each word, up to WORDS.
WORDS = 16
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 80
WHOLE = ["h1", "h2", "n"]
SKETCH = "doc_id bigint, text_id bigint, n bigint, h1 bigint, h2 bigint, signature binary"


def _whole_set(prints: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two fingerprints of each whole set."""
    sums = []
    for salt in (1, 2):
        total = np.zeros(len(prints) + 1, np.uint64)
        np.cumsum(_text.mix(prints + np.uint64(salt)), out=total[1:])
        sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)))
    return sums


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Of each document a hash of its text, its number of shingles, two fingerprints of the whole set, and the signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _text.pieces(batch.column(2)):
                _, prints, bounds = _minhash.shingles(data, offsets, size, True)
                signature = _minhash.signatures(prints, bounds, CHUNKS * WIDTH)
                own = [batch.column(i).slice(first, end - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bounds)), *_whole_set(prints, bounds), pa.array([x.tobytes() for x in signature], pa.binary())], [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_id().alias("text_id"), "text").mapInArrow(sketch, SKETCH)


def text_id():
    """What tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, keys): for each chunk, one key for each way of leaving out ERRORS values."""
    values = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    keys = []
    for kept in combinations(range(WIDTH), WIDTH - ERRORS):
        key = np.zeros((len(signature), CHUNKS), np.uint64)
        for i in kept:
            key = key * np.uint64(65537) + values[:, :, i] + np.uint64(1)
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(sum(1 << i for i in kept))
        keys.append(_text.mix(key ^ _text.mix(place)))
    return np.concatenate(keys, axis=1)


def _keys(classes: DataFrame) -> DataFrame:
    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1))
                each = np.repeat(np.arange(part.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), part.column(0).take(pa.array(each))], ["key", "id"])

    # sets of fewer than four shingles reach 0.8 with equal sets only, and those are one class already
    return classes.filter("n >= 4").select(F.col("node").alias("id"), "signature").mapInArrow(enumerate_keys, "key bigint, id bigint")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, h1, h2, n, prints): the sorted shingles of each document, and the fingerprints of its set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _text.pieces(batch.column(1)):
                _, prints, bounds = _minhash.shingles(data, offsets, size, True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *_whole_set(prints, bounds), pa.array(np.diff(bounds)), _text.lists(bounds, prints.astype(np.int64))], ["id", *WHOLE, "prints"])

    return docs.select("doc_id", "text").mapInArrow(sets, "id bigint, h1 bigint, h2 bigint, n bigint, prints array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("prints").alias("prints_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("prints").alias("prints_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").filter(_alike("n_a", "n_b", percent))
    shared = F.size(F.array_intersect("prints_a", "prints_b"))
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), shared.alias("shared")).filter(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent).select("a", "b")


def _alike(a: str, b: str, percent: int = PERCENT):
    """Sizes between which the similarity is possible."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _reachable(n1: str, w1: str, n2: str, w2: str, percent: int = PERCENT):
    """Two sets share no more of a class of shingles than the smaller of their numbers of shingles that any two sets share.

    Bit p of word t says that class p has more than t of them, so the smaller
    numbers of all classes are the bits that two words share; the last entry
    counts what has no word.
    """
    a, b = F.col(w1), F.col(w2)
    most = F.least(a[WORDS], b[WORDS])
    for t in range(WORDS):
        most = most + F.bit_count(a[t].bitwiseAND(b[t]))
    return most * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent


def _plausible(n1: str, s1: str, n2: str, s2: str, percent: int = PERCENT):
    """The same by the shared shingles in all, which costs less and comes first."""
    return F.least(s1, s2) * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent


def _tally(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, classes and numbers of the prints of each."""
    kind = (prints.astype(np.uint64) >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((kind, ids))
    ids, kind = ids[order], kind[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(kind) != 0)]) if len(ids) else np.zeros(0, np.int64)
    return ids[heads], kind[heads], np.diff(np.r_[heads, len(ids)])


def shared_counts(sets: DataFrame) -> DataFrame:
    """(id, shared, words): how many shingles of each set another of the sets has too, in all and by class.

    Shingles are dealt by value; one that several sets of a piece of input have
    is counted there and sent on once, so no shingle gathers in one task.
    """
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            prints, ids = batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), lengths)
            _, which, count = np.unique(prints, return_inverse=True, return_counts=True)
            several = count[which] > 1
            met, kind, n = _tally(ids[several], prints[several])
            sent = np.r_[prints[~several], np.unique(prints[several])]
            owner = np.r_[ids[~several], np.full(len(sent) - int((~several).sum()), SEVERAL)]
            bucket = (sent.astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
            home = (_text.mix(met.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            by_bucket, by_home = np.argsort(bucket, kind="stable"), np.argsort(home, kind="stable")
            edges = np.arange(buckets + 1)
            b1, b2 = np.searchsorted(bucket[by_bucket], edges), np.searchsorted(home[by_home], edges)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:-1].astype(np.int32)), _text.lists(b1, sent[by_bucket]), _text.lists(b1, owner[by_bucket]), _text.lists(b2, met[by_home]), _text.lists(b2, kind[by_home]), _text.lists(b2, n[by_home])], ["bucket", "prints", "owner", "met", "kind", "n"])

    def count(table: pa.Table) -> pa.Table:
        flat = {c: np.concatenate([x.flatten().to_numpy() for x in table[c].chunks]) for c in ("prints", "owner", "met", "kind", "n")}
        _, which, times = np.unique(flat["prints"], return_inverse=True, return_counts=True)
        several = np.zeros(len(times), bool)
        several[which[flat["owner"] == SEVERAL]] = True
        own = ((times > 1) | several)[which] & (flat["owner"] != SEVERAL)
        met, kind, n = _tally(flat["owner"][own], flat["prints"][own])
        return pa.table({"id": pa.array(np.r_[flat["met"], met], pa.int64()), "kind": pa.array(np.r_[flat["kind"], kind], pa.int64()), "n": pa.array(np.r_[flat["n"], n], pa.int64())})

    dealt = sets.filter(F.col("id") != SEVERAL).select("id", "prints").mapInArrow(deal, "bucket int, prints array<bigint>, owner array<bigint>, met array<bigint>, kind array<bigint>, n array<bigint>")
    counts = dealt.groupBy("bucket").applyInArrow(count, "id bigint, kind bigint, n bigint").groupBy("id", "kind").agg(F.sum("n").alias("n"))
    each = counts.groupBy("id").agg(F.sum("n").alias("shared"), F.collect_list(F.struct("kind", "n")).alias("counts"))  # CLASSES entries at most

    def as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column(2), batch.num_rows
            flat, row = lists.flatten(), np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            table = np.zeros((rows, CLASSES), np.int64)
            table[row, flat.field("kind").to_numpy()] = flat.field("n").to_numpy()
            bits = np.uint64(1) << np.arange(CLASSES, dtype=np.uint64)
            words = [((table > t) * bits).sum(axis=1, dtype=np.uint64).astype(np.int64) for t in range(WORDS)]
            words.append(np.maximum(table - WORDS, 0).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _text.lists(np.arange(rows + 1) * (WORDS + 1), np.stack(words, axis=1).ravel())], ["id", "shared", "words"])

    return each.mapInArrow(as_words, "id bigint, shared bigint, words array<bigint>")


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys that still hold two components, with their component."""
    labelled = members.join(labels.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key").checkpoint()
    return labelled.join(open_keys, "key")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, text_id, by shingles of `size` words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = sketches(docs, size).checkpoint()
    classes = sketch.filter("n > 0 and doc_id is not null").groupBy(*WHOLE).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")).withColumn("node", F.col("id"))
    repeated = not sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()
    if repeated:
        # unlike texts of one doc_id may both stand for their classes, which then need names of their own
        several = classes.groupBy("id").agg(F.count("*").alias("classes")).filter("classes > 1").select("id", F.lit(True).alias("several"))
        classes = classes.join(several, "id", "left").withColumn("node", F.when(F.col("several"), F.xxhash64(*WHOLE)).otherwise(F.col("id"))).drop("several").checkpoint()
    keys = _keys(classes)
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).filter("members > 1").select("key", "leader").checkpoint()
    # a join of two tables, not of a table with its own sums: adaptive execution can split a key that very many share, here and below
    members = keys.join(leaders, "key").checkpoint()

    wanted = members.select("id").distinct()
    if repeated:
        wanted = wanted.join(classes.select(F.col("node").alias("id"), F.col("id").alias("doc_id")), "id").select("doc_id").distinct()
        sets = shingle_sets(docs.join(wanted, "doc_id", "left_semi"), size).drop("id").join(classes.select(*WHOLE, F.col("node").alias("id")), WHOLE).dropDuplicates(["id"])  # rows of one id hold one set
    else:
        sets = shingle_sets(docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), size)
    sets = sets.select("id", "n", "prints").checkpoint()

    starred = lambda rows, leader: rows.select(F.least("id", leader).alias("a"), F.greatest("id", leader).alias("b")).filter("a <> b").distinct()
    tried = starred(members, "leader").checkpoint()
    edges = confirmed(tried, sets).checkpoint()
    labels = _graph.connected(edges)

    # what is still apart: who has too few shared shingles for any partner drops out of the comparison by the bound
    rest = _across(members.drop("leader"), labels).checkpoint()
    shared = shared_counts(sets.join(rest.select("id").distinct(), "id", "left_semi")).join(sets.select("id", "n"), "id")
    rest = rest.join(shared, "id").filter(F.col("shared") * 100 >= F.col("n") * PERCENT).checkpoint()
    central = rest.groupBy("key").agg(F.max_by(F.struct("id", "n", "shared", "words", "component"), F.struct(F.col("shared") / F.col("n"), "id")).alias("leader")).checkpoint()
    met = rest.join(central, "key").filter(F.col("component") != F.col("leader.component")).filter(_alike("n", "leader.n") & _plausible("n", "shared", "leader.n", "leader.shared"))
    again = starred(met, "leader.id").join(tried, ["a", "b"], "left_anti").checkpoint()
    edges = edges.union(confirmed(again, sets)).checkpoint()
    labels = _graph.connected(edges)

    rest = _across(rest.select("key", "id", "n", "shared", "words"), labels).checkpoint()
    other = rest.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("shared").alias("shared2"), F.col("words").alias("words2"), F.col("component").alias("component2"))
    pairs = rest.join(other, "key").filter(F.col("component") < F.col("component2")).filter(_alike("n", "n2")).filter(F.when(_plausible("n", "shared", "n2", "shared2"), _reachable("n", "words", "n2", "words2")).otherwise(False))
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct().join(tried.union(again), ["a", "b"], "left_anti")
    labels = _graph.connected(edges.union(confirmed(pairs, sets)).checkpoint())

    # copies of a class have one row in `classes`; adaptive execution splits a large class here
    found = classes.select(*WHOLE, "id", F.col("node")).join(labels.withColumnRenamed("id", "node"), "node", "left").select(*WHOLE, "id", F.coalesce("component", "node").alias("component"))
    if repeated:
        found = found.join(found.groupBy("component").agg(F.min("id").alias("least")), "component").withColumn("component", F.col("least"))
    return sketch.join(found.select(*WHOLE, "component"), WHOLE, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce((F.col("n") == 0) | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"),
        "text_id",
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
