"""Zone maps: what is known of each block of a raster, so that windows read few of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stored:
    """A raster in blocks (RASTER_BLOCK) of `size` x `size` and its place in the world; zones: its zone map, if it is kept beside it."""

    blocks: DataFrame
    height: int
    width: int
    transform: tuple
    size: int
    zones: DataFrame | None = None

    def zone_map(self) -> DataFrame:
        return zone_map(self.blocks) if self.zones is None else self.zones


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def zone_map(blocks: DataFrame) -> DataFrame:
    """(raster_id, band, block_row, block_col, row0, col0, h, w, n_valid, low, high) of each block: a row a block, to be written once."""
    there = F.filter("data", _valid)
    return blocks.select("raster_id", "band", "block_row", "block_col", "row0", "col0", "h", "w", F.size(there).alias("n_valid"), F.array_min(there).alias("low"), F.array_max(there).alias("high"))


def windows(tiles: DataFrame, raster: Stored) -> DataFrame:
    """World boxes (tile, left, bottom, right, top) as windows of pixels (tile, r0, c0, r1, c1) of a raster, snapped as read_window() does and cut at its edges; `pixels` counts those of the whole window."""
    a, _, c, _, e, f = map(float, raster.transform)
    snap = lambda x: F.floor(x + 0.5).cast("bigint")
    r0, c0 = snap((F.col("top") - f) / e), snap((F.col("left") - c) / a)
    h = F.greatest(F.lit(1), snap((F.col("bottom") - F.col("top")) / e))
    w = F.greatest(F.lit(1), snap((F.col("right") - F.col("left")) / a))
    cut = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n), x)).cast("bigint")
    return tiles.select("tile", cut(r0, raster.height).alias("r0"), cut(c0, raster.width).alias("c0"), cut(r0 + h, raster.height).alias("r1"), cut(c0 + w, raster.width).alias("c1"), (h * w).alias("pixels"))


def _touched(tiles: DataFrame, raster: Stored) -> DataFrame:
    """A row for each tile and block that meet: the place of the overlap in the block (a0, b0, a1, b1), and the zone map's row."""
    w = windows(tiles, raster).filter("r0 < r1 and c0 < c1")
    over = lambda a, b: F.explode(F.expr(f"sequence(cast({a} div {raster.size} as int), cast(({b} - 1) div {raster.size} as int))"))
    w = w.withColumn("block_row", over("r0", "r1")).withColumn("block_col", over("c0", "c1"))
    met = w.join(raster.zone_map(), ["block_row", "block_col"])
    low = lambda x, first: F.greatest(F.col(x) - F.col(first), F.lit(0))
    high = lambda x, first, n: F.least(F.col(x) - F.col(first), F.col(n))
    met = met.withColumns({"a0": low("r0", "row0"), "a1": high("r1", "row0", "h"), "b0": low("c0", "col0"), "b1": high("c1", "col0", "w")})
    return met.withColumn("overlap", (F.col("a1") - F.col("a0")) * (F.col("b1") - F.col("b0")))


def coverage(tiles: DataFrame, raster: Stored, least: int = 0) -> DataFrame:
    """(tile, pixels, n_valid) of boxes over a raster: how many pixels a window has, and how many of them are valid.

    Blocks that lie wholly in a window, or are wholly valid or empty, count by the
    zone map; only the others are read, and of tiles that can't have `least`
    valid pixels none (their n_valid is what the rest of them has).
    """
    met = _touched(tiles, raster)
    known = F.when(F.col("overlap") == F.col("h") * F.col("w"), F.col("n_valid")).when(F.col("n_valid") == 0, 0).when(F.col("n_valid") == F.col("h") * F.col("w"), F.col("overlap"))
    met = met.withColumn("known", known)
    bound = F.least(F.col("overlap"), F.col("n_valid"))
    hopeful = met.groupBy("tile").agg(F.sum(bound).alias("most")).filter(F.col("most") >= least).select("tile")
    open_ = met.filter("known is null").join(hopeful, "tile", "left_semi").select("tile", "block_row", "block_col", "a0", "a1", "b0", "b1", F.col("w").alias("across"))
    read = open_.join(raster.blocks.select("block_row", "block_col", "data"), ["block_row", "block_col"])
    rows = F.expr("flatten(transform(sequence(a0, a1 - 1), a -> slice(data, cast(a * across + b0 + 1 as int), cast(b1 - b0 as int))))")
    counted = read.select("tile", F.size(F.filter(rows, _valid)).alias("known"))
    n = met.filter("known is not null").select("tile", "known").unionByName(counted).groupBy("tile").agg(F.sum("known").alias("n"))
    every = windows(tiles, raster).select("tile", "pixels")
    return every.join(n, "tile", "left").select("tile", "pixels", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_valid"))


def usable_tiles(tiles: DataFrame, a: Stored, b: Stored, least: int = 1) -> DataFrame:
    """F14 over rasters of unlike grids: tiles (tile, left, bottom, right, top) with `least` valid pixels in both: tile, n_a, n_b, pct_a, pct_b."""
    pct = lambda n, of: 100.0 * F.col(n) / F.col(of)
    found = coverage(tiles, a, least).withColumnsRenamed({"pixels": "pixels_a", "n_valid": "n_a"}).filter(F.col("n_a") >= least)
    # only what the first raster left is looked up in the second
    rest = tiles.join(found.select("tile"), "tile", "left_semi")
    other = coverage(rest, b, least).withColumnsRenamed({"pixels": "pixels_b", "n_valid": "n_b"}).filter(F.col("n_b") >= least)
    return found.join(other, "tile").select("tile", "n_a", "n_b", pct("n_a", "pixels_a").alias("pct_a"), pct("n_b", "pixels_b").alias("pct_b"))
