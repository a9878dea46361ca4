"""Operator 9: embedding near-dedup by randomised-rotation binary codes.

Each unit vector is turned by a random rotation; the signs are its code, and
the stored correction factor is the inner product of the vector with its code's
unit vector. Code and factor give an unbiased estimate of the inner product
with any other vector, and its confidence bound (Z standard errors) decides
which pairs are computed again, exactly and in double precision. Links are what
the exact value confirms.

Pairs meet in tables of sign bits of further rotations; the number of tables
follows from the bits so that a pair at the threshold is missed with
probability MISS at most, and pairs above it with less. A pair counts in the
first table where it meets. Equal vectors are one class with a weight. A bucket
of more than BLOCK vectors is split into blocks, and each pair of blocks is a
group of its own; no pair leaves a task, only the number of links of each vector
and a spanning forest of the links (each vector with the smallest id that it
reaches in the group), which keeps all components. The vectors travel with each
table: links of a group are counted where both ends are, and to fetch vectors
for pairs would make a row of every pair of a large group.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; equal vectors are links of each other; a vector of
any length is one row; vectors of different lengths do not link; rows
equal in vec_id and vector are returned once; rows that repeat a vec_id with
other components share its component; rows without vec_id take no part and are
kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph, _text

COSINE = 0.9
MISS = 1e-3
BLOCK = 2000
#: Standard errors of the estimate within which a pair is computed exactly.
Z = 4.0


@lru_cache(maxsize=64)
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random rotation of d dimensions; every task makes the same."""
    q, r = np.linalg.qr(np.random.default_rng((d, k)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def _planes(d: int, n: int) -> np.ndarray:
    return np.concatenate([rotation(d, k + 1) for k in range(-(-n // d))], axis=1)[:, :n]


def tables_for(n: int) -> tuple[int, int]:
    """(tables, bits of each): buckets of about 256 vectors, and MISS at the threshold."""
    bits = max(8, round(math.log2(max(n, 1) / 256)))
    meet = (1 - math.acos(COSINE) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - meet)), bits


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (unit @ _planes(unit.shape[1], tables * bits) > 0).reshape(len(unit), tables, bits)
    keys = np.zeros((len(unit), tables), np.uint64)
    for b in range(bits):
        keys = keys * np.uint64(2) + signs[:, :, b]
    return _text.mix(keys + np.array([unit.shape[1]], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes, packed, and correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(packed: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors (rows) with unit vectors (columns), and a standard error for each row."""
    d = unit.shape[1]
    signs = (np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    turned = (unit @ rotation(d, 0)).astype(np.float32)
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1))
    return (signs @ turned.T) / factor[:, None], error


def _by_length(table: pa.Table | pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    lengths = np.array([len(x) for x in table.column(name).to_pylist()])
    for d in np.unique(lengths):
        yield np.flatnonzero(lengths == d)


def _index(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for rows in _by_length(part, "embedding"):
                    own = part.take(pa.array(rows))
                    unit = unit_rows(own.column("embedding").to_pylist())
                    packed, factor = codes(unit)
                    keys = table_keys(unit, tables, bits)
                    each = pa.array(np.repeat(np.arange(len(rows)), tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(keys.ravel()), own.column("id").take(each), own.column("weight").take(each), pa.array([x.tobytes() for x in packed], pa.binary()).take(each), pa.array(factor.astype(np.float32)).take(each), own.column("embedding").take(each)],
                        ["t", "key", "id", "weight", "code", "factor", "embedding"],
                    )

    kind = dict(classes.dtypes)["embedding"]
    return classes.select("id", "weight", "embedding").mapInArrow(place, f"t int, key bigint, id bigint, weight bigint, code binary, factor float, embedding {kind}")


def _bucket_links(tables: int, bits: int):
    """Of one part, whole (table, key, block pair) groups: (id, links, other), other being the smallest id that it reaches there."""

    def links(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values("id")  # so that the first place of several has the smallest id
        ids, sums, ends = [], [], []
        for (t, _, low, high), group in frame.groupby(["t", "key", "low", "high"], sort=False):
            if len(group) < 2:
                continue
            unit = unit_rows(group["embedding"].tolist())
            packed = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
            factor = group["factor"].to_numpy(np.float64)
            about, error = estimates(packed, factor, unit)
            # enough margin for the single precision of the estimate
            a, b = np.nonzero(np.triu(about + Z * error[:, None] >= COSINE - 1e-4, 1))
            if low != high:
                block = group["block"].to_numpy()
                apart = block[a] != block[b]
                a, b = a[apart], b[apart]
            linked = np.empty(len(a), bool)
            for at in range(0, len(a), 100_000):
                linked[at : at + 100_000] = np.einsum("ij,ij->i", unit[a[at : at + 100_000]], unit[b[at : at + 100_000]]) >= COSINE
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            if t:
                keys = table_keys(unit, tables, bits)[:, :t]
                first = np.concatenate([~(keys[a[at : at + 100_000]] == keys[b[at : at + 100_000]]).any(axis=1) for at in range(0, len(a), 100_000)])
                a, b = a[first], b[first]
            if not len(a):
                continue
            vec, weight = group["id"].to_numpy(), group["weight"].to_numpy()
            total = np.bincount(a, weight[b], len(vec)) + np.bincount(b, weight[a], len(vec))
            met = np.flatnonzero(total)
            ids.append(vec[met])
            sums.append(total[met].astype(np.int64))
            ends.append(vec[_graph.roots(a, b, len(vec))[met]])
        every = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, sums, ends)]
        out = pd.DataFrame(dict(zip(("id", "links", "other"), every, strict=True))).groupby(["id", "other"], as_index=False)["links"].sum()
        return pa.table({k: pa.array(out[k].to_numpy(np.int64), pa.int64()) for k in ("id", "links", "other")})

    return links


def embedding_near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").distinct().checkpoint()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    classes = vectors.filter(usable).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).checkpoint()
    n = classes.count()
    tables, bits = tables_for(n)
    rows = _index(classes, tables, bits)

    # one row for each bucket that is split; a bucket holds more than BLOCK vectors
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // 20_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("t", "key", "low", "high"), F.lit(parts)).cast("int"))
    found = rows.select("part", "t", "key", "low", "high", "block", "id", "weight", "code", "factor", "embedding").groupBy("part").applyInArrow(_bucket_links(tables, bits), "id bigint, links bigint, other bigint").checkpoint()

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = _graph.connected(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = classes.join(links, "id", "left").join(labels, "id", "left").select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = vectors.filter(usable).join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
