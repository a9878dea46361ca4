"""Template matching (G4) and image arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blockwise


def gray(r: Column, g: Column, b: Column) -> Column:
    """P33."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b)


def overlay(base: Column, colour: Column, share: float = 0.3) -> Column:
    """P34."""
    return (1 - share) * base + share * colour


def water(mask: Column) -> Column:
    """P19."""
    return (mask > 127).cast("int")


def bands(px: DataFrame) -> DataFrame:
    """Pixels (r, c, band, v) as one row with b1, b2, b3."""
    return px.groupBy("r", "c").pivot("band", [1, 2, 3]).agg(F.first("v")).withColumnsRenamed({"1": "b1", "2": "b2", "3": "b3"})


#: Pixels of a template at most: it goes to every task.
TEMPLATE_MOST = 1 << 24
SCORES = "dr bigint, dc bigint, score double, n bigint"


def _template_array(template: DataFrame, height: int, width: int) -> np.ndarray:
    if height * width > TEMPLATE_MOST:
        raise ValueError(f"a template of {height} x {width} pixels is more than TEMPLATE_MOST")
    out = np.full((height, width), np.nan)
    inside = template.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1) & F.col("v").isNotNull())
    found = inside.select(F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("double")).toPandas()
    out[found["r"], found["c"]] = found["v"]
    return out


def _fast(n: int) -> int:
    """The next length that is a product of 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def correlations(region: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of a template with every place of a region where it fits whole, over the pixels that both have, and how many those are; NaN where one of them is flat.

    Sums over the overlap are six products of spectra, so the cost doesn't grow with the template.
    """
    there, t_there = ~np.isnan(region), ~np.isnan(template)
    v = np.where(there, region - (region[there].mean() if there.any() else 0.0), 0.0)
    t = np.where(t_there, template - (template[t_there].mean() if t_there.any() else 0.0), 0.0)
    shape = tuple(map(_fast, region.shape))
    spectra = [np.fft.rfft2(x, shape) for x in (there.astype(float), v, v * v)]
    reverse = [np.conj(np.fft.rfft2(x, shape)) for x in (t_there.astype(float), t, t * t)]
    rows, cols = region.shape[0] - template.shape[0] + 1, region.shape[1] - template.shape[1] + 1
    total = lambda a, b: np.fft.irfft2(spectra[a] * reverse[b], shape)[:rows, :cols]
    n = np.rint(total(0, 0))
    with np.errstate(all="ignore"):
        mean_v, mean_t = total(1, 0) / n, total(0, 1) / n
        var_v, var_t = total(2, 0) / n - mean_v**2, total(0, 2) / n - mean_t**2
        # rounding leaves some 1e-15 of the largest sums in a flat place
        varies = (var_v > 1e-11 * np.mean(v * v) + 1e-24) & (var_t > 1e-11 * np.mean(t * t) + 1e-24)
        score = np.where(varies, (total(1, 1) / n - mean_v * mean_t) / np.sqrt(var_v * var_t), np.nan)
    return np.clip(score, -1.0, 1.0), n


def _matched(template: DataFrame, image: DataFrame, shape: tuple[int, int], t_shape: tuple[int, int], chunk: int | None, pick, least_std: float = 0.0) -> DataFrame:
    t = _template_array(template, *t_shape)
    height, width = shape
    grid = blockwise.Grid(height, width, chunk or max(256, *map(_fast, t_shape)))

    def step(r0: int, c0: int, h: int, w: int, region: np.ndarray) -> pa.Table:
        spread = np.nanstd(region) if np.isfinite(region).any() else 0.0
        if region.shape[0] < t_shape[0] or region.shape[1] < t_shape[1] or spread < least_std:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        else:
            score, n = correlations(region, t)
            row, col = pick(score, n)
            found = r0 + row, c0 + col, score[row, col], n[row, col].astype(np.int64)
        return pa.table({"dr": pa.array(found[0], pa.int64()), "dc": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64(), from_pandas=True), "n": pa.array(found[3], pa.int64())})

    return blockwise.neighbourhoods(blockwise.pack(image, grid), grid, ((0, t_shape[0] - 1), (0, t_shape[1] - 1)), step, SCORES, "clip")


def match_scores(template: DataFrame, image: DataFrame, height: int, width: int, t_height: int, t_width: int, chunk: int | None = None) -> DataFrame:
    """Correlation of a template (r, c, v) with every full offset of the image, chunk by chunk by FFT; pixels missing on either side don't count."""
    return _matched(template, image, (height, width), (t_height, t_width), chunk, lambda score, n: np.nonzero(n > 0))


def best_offsets(template: DataFrame, image: DataFrame, height: int, width: int, t_height: int, t_width: int, chunk: int | None = None, least_std: float = 0.0) -> DataFrame:
    """The best offset of each chunk of match_scores(), a row for each; chunks that vary by less than least_std are left out."""

    def best(score: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if np.isnan(score).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # argmax takes the first, and so the smallest offset, of scores that are equal to nine decimals
        at = np.unravel_index(np.nanargmax(np.round(score, 9)), score.shape)
        return np.array([at[0]]), np.array([at[1]])

    return _matched(template, image, (height, width), (t_height, t_width), chunk, best, least_std)


def best_match(scores: DataFrame, warn: float = 0.7) -> DataFrame:
    """The best offset of all, ties (to nine decimals) to the smaller one."""
    return scores.agg(F.max_by(F.struct("dr", "dc", "score"), F.struct(F.round("score", 9), -F.col("dr"), -F.col("dc"))).alias("b")).select("b.dr", "b.dc", "b.score", (F.col("b.score") >= warn).alias("confident"))


def coarse_candidates(template: DataFrame, image: DataFrame, height: int, width: int, t_height: int, t_width: int, k: int, keep: int = 4) -> list[tuple[int, int]]:
    """Offsets near which a template may lie, by k x k means of both: the best of the chunks' best, `keep` of them."""
    mean = lambda px: px.groupBy(F.floor(F.col("r") / k).cast("bigint").alias("r"), F.floor(F.col("c") / k).cast("bigint").alias("c")).agg(F.avg("v").alias("v"))
    whole = lambda px, h, w: px.filter((F.col("r") < h // k * k) & (F.col("c") < w // k * k))
    found = best_offsets(mean(whole(template, t_height, t_width)), mean(whole(image, height, width)), height // k, width // k, t_height // k, t_width // k)
    return [(r["dr"] * k, r["dc"] * k) for r in found.filter("score is not null").orderBy(F.desc(F.round("score", 9)), "dr", "dc").limit(keep).collect()]
