"""Nearest points where density varies (J9, J10), by a quadtree of bounded cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from .joins import nearest

#: Levels that a cell is split by at once, and the deepest level.
STEP, DEEPEST = 2, 40


@dataclass(frozen=True)
class Quadtree:
    """nodes (level, qx, qy, n, x_min, x_max, y_min, y_max, leaf): the cells that hold points, by level; points with the leaf (level, qx, qy) of each."""

    nodes: DataFrame
    points: DataFrame
    deepest: int


def quadtree(points: DataFrame, bound: int = 512) -> Quadtree:
    """Cells of points (x, y, ..) of `bound` points at most; points at one and the same place can't be told apart and stay together.

    Cells that hold more are split level by level; in each round only their
    points are counted, after partial sums.
    """
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y0 = box["x0"] or 0.0, box["y0"] or 0.0
    side = max((box["x1"] or 0.0) - x0, (box["y1"] or 0.0) - y0, 1e-9) * (1 + 1e-12)
    nodes, placed, rest, level = None, None, points, 0
    while True:
        cells = 1 << level
        at = lambda v, first: F.least(F.lit(cells - 1), F.floor((F.col(v) - F.lit(first)) / side * cells)).cast("bigint")  # noqa: E731, B023
        rest = rest.withColumns({"qx": at("x", x0), "qy": at("y", y0)})
        counts = rest.groupBy("qx", "qy").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
        one_place = F.expr("x_min = x_max and y_min = y_max")
        found = shared.written(counts.select(F.lit(level).alias("level"), "qx", "qy", "n", "x_min", "x_max", "y_min", "y_max", ((F.col("n") <= bound) | one_place | F.lit(level >= DEEPEST)).alias("leaf")), "cells")
        nodes = found if nodes is None else nodes.union(found)
        here = shared.written(rest.join(found.select("qx", "qy", "leaf"), ["qx", "qy"]), "points")
        done = here.filter("leaf").drop("leaf").withColumn("level", F.lit(level))
        placed = done if placed is None else placed.unionByName(done)
        rest = here.filter("not leaf").drop("leaf", "qx", "qy")
        if found.filter("not leaf").isEmpty():
            return Quadtree(nodes, placed, level)
        level += STEP


def _nearest_in(v: str) -> Column:
    """How far a centre is from the nearest place of a cell's box along one axis."""
    return F.greatest(F.lit(0.0), F.col(f"{v}_min") - F.col(f"c{v}"), F.col(f"c{v}") - F.col(f"{v}_max"))


def _farthest_in(v: str) -> Column:
    return F.greatest(F.abs(F.col(f"{v}_min") - F.col(f"c{v}")), F.abs(F.col(f"{v}_max") - F.col(f"c{v}")))


def knn(centres: DataFrame, points: DataFrame, k: int, bound: int = 512) -> DataFrame:
    """The k nearest points (id, x, y, ..) of each centre (block, cx, cy), wherever they are; ties by id. Columns as of joins.nearest().

    Centres go down the tree together. In each round a centre keeps the cells
    that may hold one of its k nearest: those no farther than the radius within
    which the cells seen so far are sure to have k points. Only the leaves that
    are left are joined with their points.
    """
    tree = quadtree(points, bound)
    nodes = tree.nodes.withColumnRenamed("level", "lv")
    centres = centres.select("block", "cx", "cy")
    by_reach = W.partitionBy("block").orderBy("far", "lv", "qx", "qy").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("block")

    def pruned(reached: DataFrame) -> DataFrame:
        near = F.sqrt(_nearest_in("x") * _nearest_in("x") + _nearest_in("y") * _nearest_in("y"))
        far = F.sqrt(_farthest_in("x") * _farthest_in("x") + _farthest_in("y") * _farthest_in("y"))
        reached = reached.withColumns({"near": near, "far": far}).withColumn("seen", F.sum("n").over(by_reach))
        # the reach of the first cells that have k points together; all cells, where there are fewer
        sure = F.coalesce(F.min(F.when(F.col("seen") >= k, F.col("far"))).over(all_), F.lit(float("inf")))
        # a little more than that, since squares and roots round
        return reached.withColumn("sure", sure * (1 + 1e-12)).filter("near <= sure").drop("near", "far", "seen")

    frontier = centres.join(nodes.filter("lv = 0").hint("broadcast"))  # the root alone
    for level in range(STEP, tree.deepest + 1, STEP):
        frontier = shared.written(pruned(frontier).drop("sure"), "frontier")
        parents = frontier.filter("not leaf").select("block", "cx", "cy", F.col("qx").alias("px"), F.col("qy").alias("py"))
        below = nodes.filter(F.col("lv") == level).withColumns({"px": F.shiftright("qx", STEP), "py": F.shiftright("qy", STEP)})
        frontier = frontier.filter("leaf").unionByName(parents.join(below, ["px", "py"]).drop("px", "py"))
    leaves = pruned(frontier).select("block", "cx", "cy", F.col("lv").alias("level"), "qx", "qy", "sure")
    d = lambda v: F.col(v) - F.col(f"c{v}")
    pairs = leaves.join(tree.points, ["level", "qx", "qy"]).drop("level", "qx", "qy").withColumn("dist", F.sqrt(d("x") * d("x") + d("y") * d("y")))
    return nearest(pairs.filter("dist <= sure").drop("sure"), k)
