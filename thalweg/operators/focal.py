"""Focal and resampling operators (W1-W8, G8). Filters are numpy steps on blocks that exchange their edges (blockwise.py)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import taper
from . import blockwise

PIXELS = "r bigint, c bigint, v double"


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    return [(k - radius, x / sum(w)) for k, x in enumerate(w)]


def smooth_along(px: DataFrame, axis: str, n: int, kernel: list[tuple[int, float]], other: int = blockwise.OPEN) -> DataFrame:
    """One pass of a separable filter over pixels (r, c, v) of an axis of length n, mirrored at its ends with the edge pixel repeated.

    Missing pixels add nothing; `other` is the length of the other axis, where it is known.
    """
    radius = max(abs(k) for k, _ in kernel)
    weights = np.zeros(2 * radius + 1)
    for k, w in kernel:
        weights[k + radius] += w
    size = block_size(radius)
    along, halo = (0, ((radius, radius), (0, 0))) if axis == "r" else (1, ((0, 0), (radius, radius)))
    grid = blockwise.Grid(n, other, size) if axis == "r" else blockwise.Grid(other, n, size)

    def step(r0: int, c0: int, h: int, w: int, region: np.ndarray) -> pa.Table:
        there = ~np.isnan(region)
        out = blockwise.convolved(np.where(there, region, 0.0), weights, along)
        reached = blockwise.convolved(there.astype(float), (weights != 0).astype(float), along) > 0.5
        return blockwise.pixel_table(r0, c0, {"v": out}, reached)

    return blockwise.neighbourhoods(blockwise.pack(px, grid), grid, halo, step, PIXELS)


def block_size(radius: int) -> int:
    """A side of blocks whose halos of that radius take less than the blocks themselves."""
    return min(max(256, 6 * radius), 2048)


def low_pass(px: DataFrame, height: int, width: int, sigma: float) -> DataFrame:
    """Missing pixels take the global mean, are filtered along both axes, and are missing again."""
    mean = px.agg(F.avg("v")).first()[0]
    weights = np.array([w for _, w in gaussian_kernel(sigma)])
    radius = len(weights) // 2
    grid = blockwise.Grid(height, width, block_size(radius))

    def step(r0: int, c0: int, h: int, w: int, region: np.ndarray) -> pa.Table:
        full = np.where(np.isnan(region), mean, region)
        smooth = blockwise.convolved(blockwise.convolved(full, weights, 0), weights, 1)
        return blockwise.pixel_table(r0, c0, {"v": smooth}, ~np.isnan(region[radius : radius + h, radius : radius + w]))

    return blockwise.neighbourhoods(blockwise.pack(px, grid), grid, ((radius, radius), (radius, radius)), step, PIXELS)


def dense(px: DataFrame, height: int, width: int) -> DataFrame:
    """Values put back into a dense grid, missing where there is none."""
    places = px.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("bigint").alias("r"), (F.col("id") % width).alias("c"))
    return places.join(px, ["r", "c"], "left")


def resize_linear(px: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """W2 along one axis, corners aligned: each target reads two sources; it is missing if one that counts is missing or absent."""
    scale = (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
    targets = px.sparkSession.range(n_out).select(F.col("id").alias("t"), (F.col("id") * F.lit(scale)).alias("p"))
    low = F.greatest(F.lit(0), F.least(F.floor("p"), F.lit(n_in - 2))).cast("bigint")
    high = F.least(low + 1, F.lit(n_in - 1))
    targets = targets.select("t", F.explode(F.array(F.struct(low.alias("i"), (1 - (F.col("p") - low)).alias("w")), F.struct(high.alias("i"), (F.col("p") - low).alias("w")))).alias("x")).select("t", F.col("x.i").alias(axis), F.col("x.w").alias("w")).filter("w > 0")
    other = "c" if axis == "r" else "r"
    # as many rows as the target axis has places, twice
    out = px.join(F.broadcast(targets), axis).groupBy("t", other).agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("there"))
    return out.select(F.col("t").alias(axis), other, F.when(F.col("there") > 1 - 1e-9, F.col("v")).alias("v")).select("r", "c", "v")


def resize(px: DataFrame, shape: tuple[int, int], target: tuple[int, int], method: str = "bilinear") -> DataFrame:
    """Bilinear, bicubic (W3) or spline (G8: gaps by triangles, then a tensor product of not-a-knot splines); gaps are filled, resized and masked again."""
    steps: dict[str, Callable] = {"bilinear": resize_linear, "bicubic": resize_cubic, "spline": resize_spline}
    if method not in steps:
        raise ValueError(f"method {method!r} is none of {sorted(steps)}")
    step = steps[method]
    px = dense(px, *shape)
    mean = F.broadcast(px.agg(F.avg("v").alias("mean")))
    filled = px
    if method == "spline":
        from .gaps import fill  # which builds on this module

        filled = fill(px, *shape)
    full = filled.crossJoin(mean).select("r", "c", F.coalesce("v", "mean").alias("v"))
    gaps = px.select("r", "c", F.col("v").isNull().cast("double").alias("v"))
    values = step(step(full, "r", shape[0], target[0]), "c", shape[1], target[1])
    masks = resize_linear(resize_linear(gaps, "r", shape[0], target[0]), "c", shape[1], target[1])
    return values.join(masks.select("r", "c", F.col("v").alias("gap")), ["r", "c"]).select("r", "c", F.when(F.col("gap") <= 0.5, F.col("v")).alias("v"))


def fill_lines(px: DataFrame) -> DataFrame:
    """Missing pixels by linear interpolation between the nearest valid ones of their row and of their column.

    Both weigh by the inverse of the distance between their ends; without valid
    ends on both sides a line gives nothing. Windows hold one line of the raster.
    """
    value, out = F.col("v"), px
    for line, at in (("r", "c"), ("c", "r")):
        order = W.partitionBy(line).orderBy(at)
        known = F.when(value.isNotNull(), F.struct(F.col(at).alias("p"), value.alias("v")))
        out = out.withColumn(f"_{at}0", F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn(f"_{at}1", F.first(known, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    sums, weights = F.lit(0.0), F.lit(0.0)
    for at in ("r", "c"):
        a, b = F.col(f"_{at}0"), F.col(f"_{at}1")
        span = b["p"] - a["p"]
        there = a.isNotNull() & b.isNotNull()
        line = a["v"] + (b["v"] - a["v"]) * (F.col(at) - a["p"]) / span
        sums = sums + F.when(there, line / span).otherwise(0.0)
        weights = weights + F.when(there, 1.0 / span).otherwise(0.0)
    return out.select("r", "c", F.coalesce("v", F.try_divide(sums, weights)).alias("v"))


#: The pole of the cubic B-spline's filter, and terms beyond which its powers vanish in double precision.
POLE, TERMS = math.sqrt(3) - 2, 30


def spline_weights(values: np.ndarray) -> np.ndarray:
    """Weights of the cubic B-spline through the last axis of `values`, mirrored at the ends.

    The inverse of the band (1, 4, 1) / 6 is a sum of powers of POLE, so a short convolution gives it in linear time.
    """
    terms = POLE ** np.abs(np.arange(-TERMS, TERMS + 1)) * (-6 * POLE / (1 - POLE**2))
    padded = np.pad(values, [(0, 0)] * (values.ndim - 1) + [(TERMS, TERMS)], mode="reflect")
    n = values.shape[-1]
    return sum(t * padded[..., k : k + n] for k, t in enumerate(terms))


def spline_row(values: np.ndarray, n_out: int) -> np.ndarray:
    """A cubic B-spline through the last axis of `values` (mirrored at the ends), read at n_out places, corners aligned."""
    n = values.shape[-1]
    if n == 1:
        return np.repeat(values, n_out, axis=-1)
    mirror = lambda i: np.abs((i + n - 1) % (2 * n - 2) - (n - 1))
    weights = spline_weights(values)
    p = np.arange(n_out) * ((n - 1) / max(n_out - 1, 1))
    low = np.minimum(np.floor(p).astype(int), n - 2)
    t = p - low
    basis = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    return sum(b * weights[..., mirror(low + k - 1)] for k, b in enumerate(basis))


def knotted_row(values: np.ndarray, n_out: int) -> np.ndarray:
    """A cubic spline with not-a-knot ends through the last axis of `values`, read at n_out places, corners aligned; below four points the polynomial through them."""
    n = values.shape[-1]
    p = np.arange(n_out) * ((n - 1) / max(n_out - 1, 1))
    if n < 4:
        nodes = np.arange(n)
        basis = np.array([np.prod([(p - j) / (i - j) for j in nodes if j != i], axis=0) * np.ones(n_out) for i in nodes])
        return values @ basis
    y = np.moveaxis(values, -1, 0)
    # slopes: d[i-1] + 4 d[i] + d[i+1] = 3 (y[i+1] - y[i-1]); third derivatives agree at the second and the last but one point
    right = np.empty_like(y)
    right[1:-1] = 3 * (y[2:] - y[:-2])
    right[0] = (5 * (y[1] - y[0]) + (y[2] - y[1])) / 2
    right[-1] = (5 * (y[-1] - y[-2]) + (y[-2] - y[-3])) / 2
    diagonal, upper, lower = np.r_[1.0, np.full(n - 2, 4.0), 1.0], np.r_[2.0, np.ones(n - 2)], np.r_[np.ones(n - 2), 2.0]
    for i in range(1, n):
        m = lower[i - 1] / diagonal[i - 1]
        diagonal[i] -= m * upper[i - 1]
        right[i] -= m * right[i - 1]
    d = right
    d[-1] /= diagonal[-1]
    for i in range(n - 2, -1, -1):
        d[i] = (d[i] - upper[i] * d[i + 1]) / diagonal[i]
    low = np.minimum(np.floor(p).astype(int), n - 2)
    t = (p - low).reshape(-1, *[1] * (y.ndim - 1))
    a, b, da, db = y[low], y[low + 1], d[low], d[low + 1]
    out = a * (1 + 2 * t) * (1 - t) ** 2 + da * t * (1 - t) ** 2 + b * t * t * (3 - 2 * t) + db * t * t * (t - 1)
    return np.moveaxis(out, 0, -1)


def _by_lines(px: DataFrame, axis: str, n_in: int, n_out: int, through: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """Resampling along one axis: a row for each line of pixels, many lines in one numpy step.

    Values stand at their index in a line of n_in. Missing or absent ones are
    interpolated in their line for the curve's sake, and a target is missing
    where one of the two sources beside it is.
    """
    other = "c" if axis == "r" else "r"
    there = px.filter(F.col("v").isNotNull() & F.col(axis).between(0, n_in - 1))
    lines = there.groupBy(other).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("i"), F.col("v").cast("double").alias("v"))).alias("x")).select(other, "x.i", "x.v")
    p = np.arange(n_out) * ((n_in - 1) / max(n_out - 1, 1))
    low = np.clip(np.floor(p).astype(int), 0, max(n_in - 2, 0))
    high = np.minimum(low + (p > low), n_in - 1)

    def resized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                values, known = np.empty((len(some), n_in)), np.zeros((len(some), n_in), bool)
                for k, (i, v) in enumerate(zip(some["i"], some["v"], strict=True)):
                    order = np.argsort(i)
                    known[k, i] = True
                    values[k] = np.interp(np.arange(n_in), i[order], v[order])
                out = np.where(known[:, low] & known[:, high], through(values, n_out), np.nan)
                yield pd.DataFrame({other: some[other], "v": [[None if x != x else x for x in row] for row in out.tolist()] if not known.all() else list(out)})

    out = lines.mapInPandas(resized, f"{other} bigint, v array<double>")
    return out.select(other, F.posexplode("v").alias("at", "v")).select(other, F.col("at").cast("bigint").alias(axis), "v").select("r", "c", "v")


def resize_cubic(px: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """W3 along one axis."""
    return _by_lines(px, axis, n_in, n_out, spline_row)


def resize_spline(px: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """G8 along one axis."""
    return _by_lines(px, axis, n_in, n_out, knotted_row)


def extent(px: DataFrame) -> tuple[int, int]:
    """Height and width of the grid that pixels (r, c) fill."""
    return tuple(x or 0 for x in px.agg(F.max("r") + 1, F.max("c") + 1).first())


def gradients(px: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Central differences (r, c, dzdr, dzdc) of every inner place of the grid, null beside missing pixels; edges have none."""
    if height is None or width is None:
        height, width = extent(px)
    grid = blockwise.Grid(height, width, 512)

    def step(r0: int, c0: int, h: int, w: int, region: np.ndarray) -> pa.Table:
        down = (region[2:, 1:-1] - region[:-2, 1:-1]) / 2
        right = (region[1:-1, 2:] - region[1:-1, :-2]) / 2
        row, col = np.arange(r0, r0 + h)[:, None], np.arange(c0, c0 + w)
        return blockwise.pixel_table(r0, c0, {"dzdr": down, "dzdc": right}, (row > 0) & (row < height - 1) & (col > 0) & (col < width - 1))

    return blockwise.neighbourhoods(blockwise.pack(px, grid), grid, ((1, 1), (1, 1)), step, "r bigint, c bigint, dzdr double, dzdc double", "missing")


def hillshade(px: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 2.0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Light on the slopes, 0 to 1; null beside missing pixels."""
    g = gradients(px, height, width)
    dx, dy = F.col("dzdc") * exaggeration, -F.col("dzdr") * exaggeration
    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    light = (math.sin(alt) - dx * (math.cos(az) * math.cos(alt)) - dy * (math.sin(az) * math.cos(alt))) / F.sqrt(1 + dx * dx + dy * dy)
    return g.select("r", "c", F.when(light < 0, 0.0).otherwise(light).alias("shade"))


def halo_blocks(px: DataFrame, axis: str, n: int, size: int, halo: int) -> DataFrame:
    """W7 along one axis: each pixel once for each block whose span with halo holds it."""
    count = -(-n // size)
    first = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / F.lit(float(size))).cast("int"))
    last = F.least(F.lit(count - 1), F.floor((F.col(axis) + halo) / F.lit(float(size))).cast("int"))
    out = px.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn("low", F.greatest(F.lit(0), F.col("block") * size - halo)).withColumn("high", F.least(F.lit(n), (F.col("block") + 1) * size + halo)).filter((F.col(axis) >= F.col("low")) & (F.col(axis) < F.col("high")))


def taper_blend(parts: DataFrame, axis: str, width: int) -> DataFrame:
    """Overlapping blocks (r, c, v, low, high) blended by their edge weights."""
    w = taper(F.col(axis), F.col("low"), F.col("high"), width)
    return parts.filter(F.col("v").isNotNull()).groupBy("r", "c").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"), F.count("*").alias("n_blocks"))
