"""Connected components of an edge table: union-find on pieces, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task contracts together; a graph that has no more is finished by that.
PIECE = 200_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0..n-1 with edges (a, b), the smallest node that each one reaches."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := root[root]) != root).any():
            root = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each one reaches) of edges between ids."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[roots(at[: len(a)], at[len(a) :], len(nodes))]


def _contracted(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs (v, m) of the same components, of n pairs: on each piece of PIECE, every node with its smallest one."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def star() -> pa.RecordBatch:
            v, m = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(v[v != m]), pa.array(m[v != m])], ["v", "m"])

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                if held and count + part.num_rows > PIECE:
                    yield star()
                    held, count = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                count += part.num_rows
        if held:
            yield star()

    return pairs.coalesce(1 + n // PIECE).mapInArrow(contract, "v bigint, m bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b): component is the smallest id reachable.

    No node's neighbours are gathered: pieces are contracted where they lie, and
    each step between pieces is a minimum by key (summed before the shuffle) and
    a join back, which adaptive execution splits where one node has very many
    edges. Lineage is cut by checkpoint() in each round.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
    n = pairs.count()
    while True:
        small = n <= PIECE
        pairs = _contracted(pairs, n).checkpoint()
        if small:
            break
        pairs = _small_star(_large_star(pairs)).checkpoint()
        n = pairs.count()
        # done when all pairs are (node, root): no root has a smaller neighbour, no node has two
        heads = pairs.select(F.col("m").alias("v")).distinct()
        if n > PIECE and pairs.join(heads, "v", "left_semi").isEmpty() and pairs.groupBy("v").agg(F.count_distinct("m").alias("n")).filter("n > 1").isEmpty():
            break
    return pairs.select(F.col("v").alias("id"), F.col("m").alias("component")).union(pairs.select("m", "m").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("v").alias("u"), F.col("m").alias("w")).union(pairs.select("m", "v"))
    least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("v").agg(F.min("m").alias("least"))
    linked = pairs.join(least, "v").filter("m > least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return linked.union(least).distinct()
