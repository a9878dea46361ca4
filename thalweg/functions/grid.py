"""Affine transforms, windows and the tile grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE, STRIDE = 1024, 768


def div(a: Column, b: int) -> Column:
    """Integer division of numbers that are not negative."""
    return F.floor(a / F.lit(b)).cast("bigint")


def grid_size(width: int, height: int, tile: int = TILE, stride: int = STRIDE) -> tuple[int, int]:
    """Rows and columns of tiles."""
    return (height - tile) // stride + 1, (width - tile) // stride + 1


def tile_grid(spark: SparkSession, width: int, height: int, tile: int = TILE, stride: int = STRIDE, transform: tuple = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)) -> DataFrame:
    """Every tile's place in pixels and in the world."""
    rows, cols = grid_size(width, height, tile, stride)
    a, b, c, d, e, f = transform
    if b or d:
        raise ValueError("only north-up rasters: b and d are 0")
    t = spark.range(rows * cols).select(F.col("id").alias("tile_number"), div(F.col("id"), cols).alias("grid_row"), (F.col("id") % cols).alias("grid_col"))
    t = t.withColumn("pixel_row", F.col("grid_row") * stride).withColumn("pixel_col", F.col("grid_col") * stride)
    return t.withColumns({"bounds_left": c + F.col("pixel_col") * a, "bounds_top": f + F.col("pixel_row") * e, "bounds_right": c + (F.col("pixel_col") + tile) * a, "bounds_bottom": f + (F.col("pixel_row") + tile) * e})


def window_of(left: Column, bottom: Column, right: Column, top: Column, transform: tuple) -> list[Column]:
    """The snapped pixel window of world bounds: col, row, width, height."""
    a, _, c, _, e, f = transform
    snap = lambda x: F.floor(x + 0.5).cast("bigint")
    return [snap((left - c) / a), snap((top - f) / e), F.greatest(F.lit(1), snap((right - left) / a)), F.greatest(F.lit(1), snap((bottom - top) / e))]


def to_world(row: Column, col: Column, transform: tuple, centre: bool = False) -> tuple[Column, Column]:
    """P11 and P11b."""
    a, _, c, _, e, f = transform
    half = 0.5 if centre else 0.0
    return c + (col + half) * a, f + (row + half) * e


def to_pixel(x: Column, y: Column, transform: tuple) -> tuple[Column, Column]:
    """Row and column, cut towards zero."""
    a, _, c, _, e, f = transform
    return ((y - f) / e).cast("int"), ((x - c) / a).cast("int")


def window_transform(transform: tuple, col: float, row: float) -> tuple:
    """P15."""
    a, b, c, d, e, f = transform
    return (a, b, c + col * a, d, e, f + row * e)


def transform_of_bounds(left: float, bottom: float, right: float, top: float, width: int, height: int) -> tuple:
    """P16."""
    return ((right - left) / width, 0.0, left, 0.0, -(top - bottom) / height, top)


def decimated(transform: tuple, factor: int) -> tuple:
    """P17."""
    a, b, c, d, e, f = transform
    return (a * factor, b, c, d, e * factor, f)


def taper(i: Column, low: Column, high: Column, width: int) -> Column:
    """W8 along one axis: distance to the nearer edge of [low, high) as a weight up to 1."""
    return F.least(F.lit(1.0), (F.least(i - low, high - 1 - i) + 1) / F.lit(float(width + 1)))


def sliding_tiles(i: Column, n_tiles: int, tile: int, stride: int) -> Column:
    """J8 and W11 along one axis: the tiles that hold pixel i, an array of at most ceil(tile / stride)."""
    first = F.greatest(F.lit(0), F.ceil((i - tile + 1) / F.lit(float(stride))).cast("int"))
    last = F.least(F.lit(n_tiles - 1), F.floor(i / F.lit(float(stride))).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
