"""Gaps filled by linear interpolation on the triangles of their rims.

Missing pixels are labelled block by block; pieces of one gap in neighbouring
blocks are found by their pixels along block edges and joined by connected
components. A gap with its rim is one group: its Delaunay triangulation depends
on no other pixels. Gaps of more than LARGEST pixels (what surrounds a scene,
mostly) are no such groups; they take fill_lines() instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from . import blockwise, focal

#: Missing pixels of a gap that one task triangulates; how near valid pixels are of its rim.
LARGEST, RIM = 1 << 17, 2
PIECE = "piece bigint, n bigint, gap_r array<int>, gap_c array<int>, rim_r array<int>, rim_c array<int>, rim_v array<double>, edge_r array<int>, edge_c array<int>"


def labelled(missing: np.ndarray) -> np.ndarray:
    """0 where False, and a number for each part of True cells that touch by sides."""
    at = np.where(missing, np.arange(1, missing.size + 1).reshape(missing.shape), 0)
    big = missing.size + 1
    while True:
        low = np.where(missing, at, big)
        least = low.copy()
        # runs along an axis take their smallest number at once
        for axis in (0, 1):
            x = np.moveaxis(least, axis, 1)
            wall = np.moveaxis(~missing, axis, 1)
            for flip in (slice(None), slice(None, None, -1)):
                y, w = x[:, flip], wall[:, flip]
                run = np.cumsum(w, axis=1)
                # a wall is larger than all numbers, so numbers of later runs start anew
                shifted = np.where(w, 0, y - run * (2 * big))
                x[:, flip] = np.where(w, big, np.minimum.accumulate(shifted, axis=1) + run * (2 * big))
        least = np.where(missing, least, 0)
        if np.array_equal(least, at):
            return at
        at = least


def pieces(blocks: DataFrame, grid: blockwise.Grid) -> DataFrame:
    """The parts of gaps in each block: their pixels, the valid pixels about them, and those of theirs on the block's edge."""

    def step(r0: int, c0: int, h: int, w: int, region: np.ndarray) -> pa.Table:
        missing = np.isnan(region[RIM : RIM + h, RIM : RIM + w])
        labels = labelled(missing)
        rows: list[tuple] = []
        order = np.argsort(labels, axis=None, kind="stable")
        flat = labels.ravel()[order]
        heads = np.flatnonzero(np.r_[True, np.diff(flat) != 0]) if len(flat) else np.zeros(0, int)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(flat)], strict=True):
            if flat[a] == 0:
                continue
            r, c = np.divmod(order[a:b], w)
            near = np.zeros(region.shape, bool)
            for i in range(2 * RIM + 1):
                for j in range(2 * RIM + 1):
                    near[r + i, c + j] = True
            rim_r, rim_c = np.nonzero(near & ~np.isnan(region))
            edge = (r == 0) | (r == h - 1) | (c == 0) | (c == w - 1)
            piece = int(r[0] + r0) * grid.width + int(c[0] + c0)  # its first pixel
            rows.append((piece, len(r), r + r0, c + c0, rim_r + r0 - RIM, rim_c + c0 - RIM, region[rim_r, rim_c], r[edge] + r0, c[edge] + c0))
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64()), *[pa.list_(pa.int32())] * 2]
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table({n: pa.array([row[i] for row in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return blockwise.neighbourhoods(blocks, grid, ((RIM, RIM), (RIM, RIM)), step, PIECE, "missing")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node that each one reaches, by alternating large and small stars."""
    edges = shared.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        now = shared.written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if now.exceptAll(edges).isEmpty() and edges.exceptAll(now).isEmpty():
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        edges = now


def _turn(ax, ay, bx, by, cx, cy):
    """Twice the area of a, b, c; positive if they turn left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the corners of the convex hull, turning left."""
    order = np.lexsort((y, x)).tolist()
    xs, ys = x.tolist(), y.tolist()

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for p in places:
            while len(out) > 1 and _turn(xs[out[-2]], ys[out[-2]], xs[out[-1]], ys[out[-1]], xs[p], ys[p]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(order) + half(order[::-1])


def on_triangles(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values at places (px, py) by linear interpolation on Delaunay triangles of points (x, y, v), whole numbers; NaN outside of their hull.

    A place starts in a triangle of the hull's fan. While a point lies in the
    circle through its triangle's corners, that point takes the corner's part
    without which the triangle still holds the place.
    """
    out = np.full(len(px), np.nan)
    corners = hull(x, y) if len(x) > 2 else []
    if len(corners) < 3:
        return out
    # whole numbers to the fourth power are exact in 64 bits up to here
    exact = max(np.ptp(x), np.ptp(y)) <= 16_000
    x, y, px, py = (a.astype(np.int64).astype(np.int64 if exact else np.longdouble) for a in (x, y, px, py))
    fan = np.array([(corners[0], corners[i], corners[i + 1]) for i in range(1, len(corners) - 1)])
    step = max(1, (1 << 21) // (len(x) + len(fan)))
    for at in range(0, len(px), step):
        qx, qy = px[at : at + step, None], py[at : at + step, None]
        holds = np.ones((len(qx), len(fan)), bool)
        for i, j in ((0, 1), (1, 2), (2, 0)):
            a, b = fan[:, i], fan[:, j]
            holds &= _turn(x[a], y[a], x[b], y[b], qx, qy) >= 0
        live = np.flatnonzero(holds.any(axis=1))
        if not len(live):
            continue
        tri = fan[holds[live].argmax(axis=1)]
        qx, qy = qx[live, 0], qy[live, 0]
        moving = np.arange(len(live))
        for rounds in range(50 + 4 * len(x)):
            t = tri[moving]
            # in the frame of the place the determinants are smallest
            ax, ay = x[t] - qx[moving, None], y[t] - qy[moving, None]
            dx, dy = x - qx[moving, None], y - qy[moving, None]
            lift = ax * ax + ay * ay
            m = [_turn(ax[:, i], ay[:, i], ax[:, j], ay[:, j], 0, 0) for i, j in ((1, 2), (2, 0), (0, 1))]
            area = _turn(ax[:, 0], ay[:, 0], ax[:, 1], ay[:, 1], ax[:, 2], ay[:, 2])
            # height of the plane through the lifted corners, times the area, minus that of the lifted point
            gx = sum(lift[:, i] * (ay[:, (i + 1) % 3] - ay[:, (i + 2) % 3]) for i in range(3))
            gy = sum(lift[:, i] * (ax[:, (i + 2) % 3] - ax[:, (i + 1) % 3]) for i in range(3))
            g0 = sum(lift[:, i] * m[i] for i in range(3))
            inside = gx[:, None] * dx + gy[:, None] * dy + g0[:, None] - area[:, None] * (dx * dx + dy * dy)
            # the point deepest in the circle; the first one, after many rounds, so that none comes again and again
            best = inside.argmax(axis=1) if rounds < 50 else (inside > 0).argmax(axis=1)
            deep = inside[np.arange(len(moving)), best] > 0
            moving, t, best = moving[deep], t[deep], best[deep]
            if not len(moving):
                break
            new = tri[moving]
            for k in range(3):
                some = t.copy()
                some[:, k] = best
                wx, wy = x[some] - qx[moving, None], y[some] - qy[moving, None]
                turned = np.sign(_turn(wx[:, 0], wy[:, 0], wx[:, 1], wy[:, 1], wx[:, 2], wy[:, 2]))
                ok = turned != 0
                for i, j in ((0, 1), (1, 2), (2, 0)):
                    ok &= turned * _turn(wx[:, i], wy[:, i], wx[:, j], wy[:, j], 0, 0) >= 0
                some[turned < 0, 1:] = some[turned < 0, :0:-1]
                new[ok] = some[ok]
            tri[moving] = new
        ax, ay = x[tri] - qx[:, None], y[tri] - qy[:, None]
        parts = np.stack([_turn(ax[:, i], ay[:, i], ax[:, j], ay[:, j], 0, 0) for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)
        out[at + live] = (parts * v[tri]).sum(axis=1) / parts.sum(axis=1)
    return out


def fill(px: DataFrame, height: int, width: int, size: int = 256) -> DataFrame:
    """Pixels (r, c, v) of the whole grid with gaps filled; outside of a gap's rim's hull they stay missing."""
    grid = blockwise.Grid(height, width, size)
    found = shared.written(pieces(blockwise.pack(px, grid), grid), "gaps")
    border = found.select("piece", F.explode(F.arrays_zip("edge_r", "edge_c")).alias("x")).select("piece", F.col("x.edge_r").alias("r"), F.col("x.edge_c").alias("c"))
    edges = None
    for dr, dc in ((1, 0), (0, 1)):
        beside = border.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("piece").alias("b"))
        met = border.select("r", "c", F.col("piece").alias("a")).join(beside, ["r", "c"]).select("a", "b").filter("a <> b")
        edges = met if edges is None else edges.union(met)
    roots = connected(edges)
    whole = found.join(roots, found["piece"] == roots["node"], "left").withColumn("gap", F.coalesce("root", "piece"))
    sizes = whole.groupBy("gap").agg(F.sum("n").alias("size"))
    bounded = whole.join(sizes.filter(F.col("size") <= LARGEST), "gap").select("gap", "gap_r", "gap_c", "rim_r", "rim_c", "rim_v")

    def triangulated(key: tuple, table: pa.Table) -> pa.Table:
        flat = {n: np.concatenate([c.flatten().to_numpy() for c in table[n].chunks]) for n in ("gap_r", "gap_c", "rim_r", "rim_c", "rim_v")}
        _, first = np.unique(flat["rim_r"].astype(np.int64) << 32 | flat["rim_c"], return_index=True)
        v = on_triangles(flat["gap_c"], flat["gap_r"], flat["rim_c"][first], flat["rim_r"][first], flat["rim_v"][first])
        keep = ~np.isnan(v)
        return pa.table({"r": pa.array(flat["gap_r"][keep], pa.int64()), "c": pa.array(flat["gap_c"][keep], pa.int64()), "filled": pa.array(v[keep])})

    # a group is a gap of LARGEST pixels at most
    new = bounded.groupBy("gap").applyInArrow(triangulated, "r bigint, c bigint, filled double")
    out = focal.dense(px, height, width).join(new, ["r", "c"], "left").select("r", "c", F.coalesce("v", "filled").alias("v"))
    large = whole.join(sizes.filter(F.col("size") > LARGEST), "gap").select(F.explode(F.arrays_zip("gap_r", "gap_c")).alias("x")).select(F.col("x.gap_r").cast("bigint").alias("r"), F.col("x.gap_c").cast("bigint").alias("c"), F.lit(True).alias("wide"))
    if large.isEmpty():
        return out
    lines = focal.fill_lines(out).withColumnRenamed("v", "line")
    return out.join(large, ["r", "c"], "left").join(lines, ["r", "c"]).select("r", "c", F.when(F.col("wide"), F.col("line")).otherwise(F.col("v")).alias("v"))
