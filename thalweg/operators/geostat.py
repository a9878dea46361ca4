"""Variograms and block kriging."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import taper
from .joins import nearest, neighbours


@dataclass(frozen=True)
class Variogram:
    """D13, with named fields."""

    model: str
    psill: float
    range: float
    nugget: float

    def __call__(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h, float)
        if self.model == "linear":
            shape = np.minimum(h / self.range, 1)
        elif self.model == "exponential":
            shape = 1 - np.exp(-3 * h / self.range)
        elif self.model == "gaussian":
            shape = 1 - np.exp(-3 * (h / self.range) ** 2)
        elif self.model == "spherical":
            u = np.minimum(h / self.range, 1)
            shape = 1.5 * u - 0.5 * u**3
        else:
            raise ValueError(f"unknown variogram model {self.model!r}")
        return np.where(h > 0, self.nugget + self.psill * shape, 0.0)


def sample(points: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """N rows without replacement, the same each time."""
    return points.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def variogram_bins(points: DataFrame, lags: int, reach: float) -> DataFrame:
    """Pairs of a bounded sample (id, x, y, z), binned by distance up to `reach`; variogram_within() takes all points."""
    a = points.select(F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    b = F.broadcast(points.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2")))  # a sample of known size
    dx, dy, dz = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), F.col("z1") - F.col("z2")
    return _lag_table(a.join(b, F.col("i") < F.col("j")).select(F.sqrt(dx * dx + dy * dy).alias("h"), (0.5 * dz * dz).alias("g")), lags, reach)


def _lag_table(pairs: DataFrame, lags: int, reach: float) -> DataFrame:
    return pairs.filter((F.col("h") > 0) & (F.col("h") < reach)).groupBy(F.floor(F.col("h") / (reach / lags)).cast("int").alias("lag_bin")).agg(F.avg("h").alias("lag"), F.avg("g").alias("semivariance"), F.count("*").alias("n_pairs"))


def variogram_within(points: DataFrame, lags: int, reach: float) -> DataFrame:
    """A29 over all points (x, y, z): pairs meet in square cells of `reach`, each pair once, in the cell of its lower point.

    The work grows with the points times their neighbours within reach.
    """
    cell = lambda x: F.floor(x / reach).cast("bigint")
    upper = points.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    upper = upper.withColumn("i", F.explode(F.array(*[cell(F.col("x2")) + k for k in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[cell(F.col("y2")) - k for k in (0, 1)])))
    lower = points.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"), cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j"))
    dx, dy, dz = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), F.col("z1") - F.col("z2")
    ordered = (F.col("y2") > F.col("y1")) | ((F.col("y2") == F.col("y1")) & (F.col("x2") > F.col("x1")))
    near = lower.join(upper, ["i", "j"]).filter(ordered & (dx * dx + dy * dy < reach * reach))
    return _lag_table(near.select(F.sqrt(dx * dx + dy * dy).alias("h"), (0.5 * dz * dz).alias("g")), lags, reach)


def fit_variogram(points: DataFrame, model: str = "spherical", n: int = 3000, lags: int = 20) -> Variogram:
    """G1: least squares over ranges on the lag table of a sample of n points; each lag weighs as its pairs, less with distance."""
    rows = sample(points, n).select("x", "y", "z").collect()  # n rows at most
    x, y, z = (np.array([r[k] for r in rows], float) for k in ("x", "y", "z"))
    reach = (math.hypot(np.ptp(x), np.ptp(y)) / 2 if len(x) else 0.0) or 1.0
    i, j = np.triu_indices(len(x), 1)
    h, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    near = (h > 0) & (h < reach)
    h, g = h[near], g[near]
    lag = np.floor(h / (reach / lags)).astype(int)
    w = np.bincount(lag, minlength=lags).astype(float)
    some = w > 0
    h, g, w = (np.bincount(lag, v, lags)[some] / w[some] if v is not None else w[some] for v in (h, g, None))
    if not len(h):
        return Variogram(model, 0.0, reach, 0.0)
    w = np.sqrt(w / (1 + h / reach))
    best = (math.inf, Variogram(model, float(g.mean()), reach, 0.0))
    for r in np.linspace(reach / lags, 1.5 * reach, 60):
        shape = Variogram(model, 1.0, float(r), 0.0)(h)
        fit, *_ = np.linalg.lstsq(np.c_[shape, np.ones_like(h)] * w[:, None], g * w, rcond=None)
        psill, nugget = max(float(fit[0]), 0.0), max(float(fit[1]), 0.0)
        if fit[1] < 0:
            psill = max(float((shape * w * w * g).sum() / max((shape * shape * w * w).sum(), 1e-12)), 0.0)
        miss = float((((nugget + psill * shape) - g) ** 2 * w * w).sum())
        if miss < best[0]:
            best = (miss, Variogram(model, psill, float(r), nugget))
    return best[1]


def solve_block(x: np.ndarray, y: np.ndarray, z: np.ndarray, px: np.ndarray, py: np.ndarray, model: Variogram) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging of places (px, py); one factorisation, all places as right-hand sides."""
    if len(z) < 4:
        return np.full(len(px), np.nan), np.full(len(px), np.nan)
    if z.std() < 1e-6:
        return np.full(len(px), z.mean()), np.zeros(len(px))
    n = len(z)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = model(np.hypot(x[:, None] - x, y[:, None] - y))
    a[n, n] = 0
    b = np.ones((n + 1, len(px)))
    b[:n] = model(np.hypot(x[:, None] - px, y[:, None] - py))
    weights = np.linalg.solve(a + np.diag(np.r_[np.full(n, -1e-10), 0]), b)
    return z @ weights[:n], np.maximum((weights * b).sum(axis=0), 0)


def krige_blocks(blocks: DataFrame, points: DataFrame, model: Variogram, radius: float, most: int = 36) -> DataFrame:
    """G3 for blocks (block, cx, cy, x0, y0, w, h, step): prediction and variance at every place of each block.

    Neighbours meet their block by bucketed joins; a block is one small group.
    """
    blocks = blocks.select("block", "cx", "cy", "x0", "y0", "w", "h", "step")
    near = nearest(neighbours(blocks, points, radius), most).select("block", "id", "x", "y", "z")
    return _solved(blocks.join(near, "block", "left"), model)  # blocks without points keep their places


def _solved(near: DataFrame, model: Variogram) -> DataFrame:
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        b = frame.iloc[0]
        frame = frame[frame.z.notna()].sort_values("id")
        gx, gy = np.meshgrid(b.x0 + np.arange(int(b.w)) * b.step, b.y0 + np.arange(int(b.h)) * b.step)
        value, variance = solve_block(frame.x.to_numpy(), frame.y.to_numpy(), frame.z.to_numpy(), gx.ravel(), gy.ravel(), model)
        return pd.DataFrame({"block": b.block, "x": gx.ravel(), "y": gy.ravel(), "prediction": value, "variance": variance, "n_points": len(frame)})

    return near.groupBy("block").applyInPandas(solve, "block bigint, x double, y double, prediction double, variance double, n_points int")


def krige_scene(points: DataFrame, model: Variogram, height: int, width: int, size: int = 512, halo: int = 32, radius: float | None = None, most: int = 36) -> DataFrame:
    """Square blocks with a halo on all sides, kriged and blended; (r, c, v, variance, n_blocks) at x = c, y = r.

    A block takes the `most` points nearest to its centre within radius plus half
    its diagonal; without a radius it is that of point_density(). Pixels that only
    blocks with fewer than four points hold have neither value nor variance.
    """
    spark = points.sparkSession
    if radius is None:
        radius = point_density(points).first()["radius"]
    radius = radius or 15.0  # no points, no area
    across = -(-width // size)
    i, j = F.floor(F.col("id") / across), F.col("id") % across
    blocks = spark.range(-(-height // size) * across).select(
        F.col("id").alias("block"),
        F.greatest(F.lit(0), i * size - halo).alias("low"),
        F.least(F.lit(height), (i + 1) * size + halo).alias("high"),
        F.greatest(F.lit(0), j * size - halo).alias("left"),
        F.least(F.lit(width), (j + 1) * size + halo).alias("right"),
    )
    placed = blocks.select(
        "block",
        ((F.col("left") + F.col("right") - 1) / 2).alias("cx"),
        ((F.col("low") + F.col("high") - 1) / 2).alias("cy"),
        F.col("left").cast("double").alias("x0"),
        F.col("low").cast("double").alias("y0"),
        (F.col("right") - F.col("left")).alias("w"),
        (F.col("high") - F.col("low")).alias("h"),
        F.lit(1.0).alias("step"),
    )
    span = size + 2 * halo - 1
    near = neighbours(placed, points, radius + math.hypot(min(span, width), min(span, height)) / 2)
    half = F.sqrt((F.col("w") - 1) * (F.col("w") - 1) + (F.col("h") - 1) * (F.col("h") - 1)) / 2
    some = nearest(near.filter(F.col("dist") <= radius + half), most).select("block", "id", "x", "y", "z")
    # a left join, so that blocks without any point stay
    out = _solved(placed.join(some, "block", "left"), model).join(F.broadcast(blocks), "block")  # one row a block
    r, c = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    w = F.least(taper(r, F.col("low"), F.col("high"), halo), taper(c, F.col("left"), F.col("right"), halo))
    w = F.when(F.col("prediction").isNotNull() & ~F.isnan("prediction"), w)
    parts = out.select(r.alias("r"), c.alias("c"), w.alias("w"), (w * F.col("prediction")).alias("wv"), (w * F.col("variance")).alias("ws"))
    return parts.groupBy("r", "c").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("v"), F.try_divide(F.sum("ws"), F.sum("w")).alias("variance"), F.count("w").alias("n_blocks"))


def point_density(points: DataFrame, area: Column | None = None) -> DataFrame:
    """Density, mean spacing, and the search radius that follows from it."""
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) if area is None else area
    s = points.agg(F.count("*").alias("n"), box.alias("area"))
    spacing = F.sqrt(F.col("area") / F.col("n"))
    return s.select("n", "area", (F.col("n") / F.col("area")).alias("density"), spacing.alias("spacing"), F.when(F.lit(15.0) < 3 * spacing, 5 * spacing).otherwise(15.0).alias("radius"))


def t_pvalue(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided, by the continued fraction of the incomplete beta function."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    flip = x > (a + 1) / (a + b + 2)
    p, q, u = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(u) + q * np.log1p(-u)) / p
    tiny = 1e-300
    c, d = np.ones_like(u), 1 / np.where(np.abs(1 - (p + q) * u / (p + 1)) < tiny, tiny, 1 - (p + q) * u / (p + 1))
    f = d
    for m in range(1, 300):
        for k in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            f = f * c * d
    out = front * f
    return np.where(u == 0, np.where(flip, 1.0, 0.0), np.where(flip, 1 - out, out))


def pair_pvalues(pairs: DataFrame) -> DataFrame:
    """P-values of Pearson's r and of the paired t-test, of the few rows of method pairs."""
    d = F.col("y") - F.col("x")
    s = pairs.groupBy("method_1", "method_2").agg(F.count("*").alias("n_tiles"), F.corr("x", "y").alias("r"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).filter("n_tiles >= 3")

    @F.pandas_udf("double")
    def p_of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_pvalue(t.to_numpy(), df.to_numpy()))

    n = F.col("n_tiles").cast("double")
    r = F.greatest(F.lit(-0.999999999999), F.least(F.lit(0.999999999999), F.col("r")))
    return s.select("method_1", "method_2", "n_tiles", F.round(p_of(r * F.sqrt((n - 2) / (1 - r * r)), n - 2), 9).alias("correlation_p"), F.round(p_of(F.try_divide(F.col("m") * F.sqrt(n), F.col("s")), n - 1), 9).alias("ttest_p"))
