"""Whole workflows over rasters (V9-V27), put together from the other operators.

A Raster is its pixels (r, c, v) with the few numbers that place them. Rasters
of one grid are joined by pixel; whatever is collected is one row of bounds,
counts or metadata, never pixels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import grid as G
from ..schema import RASTER_META
from ..sources import blocks as stored
from ..sources import files as sources
from ..sources import geotiff
from . import blockwise, focal, geostat, joins, stats, validate, vision, warp


@dataclass(frozen=True)
class Raster:
    """Pixels (r, c, v), null where missing, and their place in the world."""

    px: DataFrame
    height: int
    width: int
    transform: tuple = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    crs: str = "EPSG:32629"

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        a, _, c, _, e, f = map(float, self.transform)
        return c, f + self.height * e, c + self.width * a, f

    def meta(self, raster_id: str = "raster") -> DataFrame:
        """One row of RASTER_META."""
        return self.px.sparkSession.createDataFrame([(raster_id, self.width, self.height, tuple(map(float, self.transform)), self.crs, A.NODATA, "float32", self.bounds)], RASTER_META)


def save_raster(raster: Raster, path: str, tile: int = 256, raster_id: str = "raster", mode: str = "overwrite", **options) -> None:
    """K1, K3: a raster of any size as one tiled GeoTIFF, compressed by as many tasks as it has blocks."""
    grid = blockwise.Grid(raster.height, raster.width, tile)
    code = raster.crs.removeprefix("EPSG:")
    blocks = blockwise.raster_blocks(blockwise.pack(raster.px, grid), grid, raster_id)
    geotiff.save(blocks, path, raster.height, raster.width, tile, raster.transform, mode, epsg=int(code) if code.isdigit() else None, **options)


def load_raster(spark: SparkSession, path: str, band: int = 1, window: tuple[int, int, int, int] | None = None) -> Raster:
    """A band of a GeoTIFF, or its window (row0, col0, row1, col1), whose strips and tiles alone are read."""
    geotiff.register(spark)
    m = geotiff.described(path)
    blocks = spark.read.format("geotiff").load(path).filter(F.col("band") == band)
    transform, height, width = m["transform"], m["height"], m["width"]
    if window is not None:
        r0, c0, r1, c1 = window
        r1, c1 = min(r1, height), min(c1, width)
        blocks = blocks.filter((F.col("row0") < r1) & (F.col("col0") < c1) & (F.col("row0") + F.col("h") > r0) & (F.col("col0") + F.col("w") > c0))
        transform, height, width = G.window_transform(transform, c0, r0), r1 - r0, c1 - c0
        px = stored.pixels(blocks, (r0, c0, r1, c1)).select((F.col("row") - r0).cast("bigint").alias("r"), (F.col("col") - c0).cast("bigint").alias("c"), F.col("value").cast("double").alias("v"))
    else:
        px = stored.pixels(blocks).select(F.col("row").cast("bigint").alias("r"), F.col("col").cast("bigint").alias("c"), F.col("value").cast("double").alias("v"))
    return Raster(px, height, width, transform, m["crs"] or "")


def read_window(raster: Raster, bounds: tuple[float, float, float, float], shape: tuple[int, int] | None = None, method: str = "bilinear") -> Raster:
    """The snapped window of world bounds, resampled to `shape` (rows, columns) where it has another; pixels beyond the raster are missing."""
    a, _, c, _, e, f = raster.transform
    left, bottom, right, top = bounds
    snap = lambda x: math.floor(x + 0.5)
    c0, r0, w, h = snap((left - c) / a), snap((top - f) / e), max(1, snap((right - left) / a)), max(1, snap((bottom - top) / e))
    r, col = F.col("r"), F.col("c")
    inside = raster.px.filter((r >= r0) & (r < r0 + h) & (col >= c0) & (col < c0 + w)).select((r - r0).alias("r"), (col - c0).alias("c"), "v")
    out = Raster(inside, h, w, G.window_transform(raster.transform, c0, r0), raster.crs)
    if shape is None or shape == (h, w):
        return out
    return Raster(focal.resize(inside, (h, w), shape, method), *shape, G.transform_of_bounds(*out.bounds, shape[1], shape[0]), raster.crs)


on_grid = focal.dense


# tile depth


#: Methods in the order in which they are compared.
METHODS = ("webodm", "bluesky", "fusion", "kriged")


def tile_depths(tiles: DataFrame, masks: DataFrame, dsm: DataFrame, dtms: DataFrame, methods: tuple[str, ...] = METHODS, ceiling: float = 5.0) -> DataFrame:
    """Depth by tile and method over water pixels, and how each tile went.

    tiles (tile); masks (tile, r, c, v) of 8-bit images; dsm (tile, r, c, v);
    dtms (tile, method, r, c, v), all terrain models stacked, so that one join on
    (tile, r, c) serves all of them. A row for each tile and method; status is
    mask_not_found, no_water, no_dsm, no_valid_dtms, no_valid_depths or ok, of
    the tile: ok if any method has a valid depth there.
    """
    info = masks.groupBy("tile").agg(F.count_if(F.col("v") > 127).alias("n_water"))
    seen = dsm.groupBy("tile").agg(F.count("v").alias("n_dsm"))
    water = masks.filter(F.col("v") > 127).select("tile", "r", "c")
    surface = water.join(dsm.select("tile", "r", "c", F.col("v").alias("surface")), ["tile", "r", "c"])
    star = surface.join(dtms.select("tile", "r", "c", "method", F.col("v").alias("riverbed")), ["tile", "r", "c"])
    found = stats.tile_depth(star.withColumn("rank", F.lit(0)), ceiling).drop("rank", "water_pixels", "coverage_pct")
    rank = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("rank")) for i, m in enumerate(methods)])).alias("m")
    rows = tiles.select("tile").distinct().join(info, "tile", "left").join(seen, "tile", "left").select("tile", "n_water", "n_dsm", rank).select("tile", "m.method", "m.rank", "n_water", "n_dsm")
    rows = rows.join(found.withColumn("_there", F.lit(True)), ["tile", "method"], "left")
    by_tile = W.partitionBy("tile")  # as many rows as methods
    status = (
        F.when(F.col("n_water").isNull(), "mask_not_found")
        .when(F.col("n_water") == 0, "no_water")
        .when(F.coalesce("n_dsm", F.lit(0)) == 0, "no_dsm")
        .when(F.max("_there").over(by_tile).isNull(), "no_valid_dtms")
        .when(F.coalesce(F.max("valid_pixels").over(by_tile), F.lit(0)) == 0, "no_valid_depths")
        .otherwise("ok")
    )
    valid, n = F.coalesce("valid_pixels", F.lit(0)), F.coalesce("n_water", F.lit(0))
    measured = [c for c in found.columns if c not in ("tile", "method", "valid_pixels")]
    return rows.select("tile", "method", "rank", status.alias("status"), n.alias("water_pixels"), valid.alias("valid_pixels"), A.tidy(A.share(valid, n)).alias("coverage_pct"), *measured)


def outcomes(depths: DataFrame) -> DataFrame:
    """Tiles by status."""
    return depths.select("tile", "status").distinct().groupBy("status").agg(F.count("*").alias("tiles"))


def georeference(tile: Column, width: int, transform: tuple, size: int = G.TILE, stride: int = G.STRIDE) -> list[Column]:
    """Where a tile lies, from its number: pixel_row, pixel_col, left, bottom, right, top."""
    across = (width - size) // stride + 1
    row, col = G.div(tile, across) * stride, tile % across * stride
    left, top = G.to_world(row, col, transform)
    right, bottom = G.to_world(row + size, col + size, transform)
    return [x.alias(n) for x, n in ((row, "pixel_row"), (col, "pixel_col"), (left, "left"), (bottom, "bottom"), (right, "right"), (top, "top"))]


def tile_at(image: Raster, template: DataFrame, size: tuple[int, int], search: tuple[int, int, int, int] | None = None, pyramid: int | None = None, warn: float = 0.7) -> DataFrame:
    """The offset (dr, dc, score, confident) of a tile's gray pixels in an image, or in a part of it (row0, col0, row1, col1).

    Every offset is tried, chunk by chunk by FFT. With `pyramid` only those are
    that lie within so many pixels of the best offsets of the image in means of
    pyramid x pyramid: faster, and exact unless the tile is lost in the means.
    """
    r0, c0, r1, c1 = search or (0, 0, image.height, image.width)

    def part(a: int, x: int, b: int, y: int) -> tuple[DataFrame, int, int]:
        a, x, b, y = max(a, r0), max(x, c0), min(b, r1), min(y, c1)
        inside = image.px.filter(F.col("r").between(a, b - 1) & F.col("c").between(x, y - 1))
        return inside.select((F.col("r") - a).alias("r"), (F.col("c") - x).alias("c"), "v"), b - a, y - x

    def shifted(scores: DataFrame, a: int, x: int) -> DataFrame:
        return scores.withColumns({"dr": F.col("dr") + a, "dc": F.col("dc") + x})

    if pyramid is None:
        found = shifted(vision.best_offsets(template, *part(r0, c0, r1, c1), *size), r0, c0)
    else:
        near = vision.coarse_candidates(template, *part(r0, c0, r1, c1), *size, pyramid)
        found = image.px.sparkSession.createDataFrame([], vision.SCORES)
        for dr, dc in near:
            a, x = max(r0 + dr - pyramid, r0), max(c0 + dc - pyramid, c0)
            found = found.union(shifted(vision.best_offsets(template, *part(a, x, r0 + dr + pyramid + size[0], c0 + dc + pyramid + size[1]), *size), a, x))
    return vision.best_match(found, warn)


def single_tile(mask: DataFrame, dsm: Raster, dtm: Raster, position: tuple[int, int], grid: Raster, size: int = G.TILE, ceiling: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Depth statistics and river width of one tile at a known position; mask (r, c, v) within the tile.

    With an unknown one, take it from tile_at() first.
    """
    left, top = grid.transform[2] + position[1] * grid.transform[0], grid.transform[5] + position[0] * grid.transform[4]
    bounds = (left, top + size * grid.transform[4], left + size * grid.transform[0], top)
    cut = lambda x: read_window(x, bounds, (size, size)).px.withColumn("tile", F.lit(0).cast("bigint"))
    tile = mask.withColumn("tile", F.lit(0).cast("bigint"))
    surface, bed = cut(dsm), cut(dtm).withColumn("method", F.lit("dtm"))
    depths = tile_depths(tile.select("tile").distinct(), tile, surface, bed, ("dtm",), ceiling)
    both = joins.coregister(surface, bed, ("surface", "bed")).join(mask.select("r", "c", (F.col("v") > 127).alias("water")), ["r", "c"])
    width = stats.river_width(both.select(F.lit(0).alias("tile"), "r", "c", "water", (F.col("surface") - F.col("bed")).alias("depth")), ceiling, abs(grid.transform[0]))
    return depths, width


def compare_dtm_sources(mask: DataFrame, dsm: DataFrame, fine: DataFrame, coarse: Raster, shape: tuple[int, int], offset: float = 58.0, method: str = "bicubic", ceilings: tuple[float, float] = (10.0, 5.0)) -> DataFrame:
    """For one tile, depths against its own terrain model and against a coarse one, shifted and resampled; the difference of the two models beside them."""
    shifted = coarse.px.select("r", "c", A.shifted(F.col("v"), offset).alias("v"))
    other = focal.resize(shifted, (coarse.height, coarse.width), shape, method)
    all3 = joins.coregister(dsm, fine, ("dsm", "fine")).join(other.select("r", "c", F.col("v").alias("coarse")), ["r", "c"]).join(mask.select("r", "c", (F.col("v") > 127).alias("water")), ["r", "c"])
    gap = F.col("coarse") - F.col("fine")
    columns = [F.count(gap).alias("n"), A.tidy(F.avg(gap)).alias("dtm_diff_mean"), A.tidy(F.stddev_pop(gap)).alias("dtm_diff_std")]
    for name, ceiling in zip(("fine", "coarse"), ceilings, strict=True):
        depth = F.when(F.col("water") & A.physical(F.col("dsm") - F.col(name), ceiling), F.col("dsm") - F.col(name))
        columns += [F.count(depth).alias(f"{name}_valid"), A.tidy(F.avg(depth)).alias(f"{name}_depth_mean"), A.tidy(F.median(depth)).alias(f"{name}_depth_median"), A.tidy(F.stddev_pop(depth)).alias(f"{name}_depth_std")]
    return all3.agg(*columns)


# terrain models


def run_fusion(dsm: DataFrame, dtm: DataFrame, height: int, width: int, sigma: float, scale: float = 2.0, ceiling: float = 50.0) -> DataFrame:
    """Terrain with the surface's fine detail where the canopy is low: (r, c, ndsm, alpha, detail, fused)."""
    both = joins.coregister(dsm, dtm, ("dsm", "dtm"))
    low = focal.low_pass(dsm, height, width, sigma).select("r", "c", F.col("v").alias("low"))
    h = A.clipped(F.col("dsm") - F.col("dtm"), 0.0, ceiling)
    alpha, detail = A.canopy_weight(h, scale), F.col("dsm") - F.col("low")  # P10: high-pass
    return both.join(low, ["r", "c"], "left").select("r", "c", h.alias("ndsm"), alpha.alias("alpha"), detail.alias("detail"), A.fused(F.col("dtm"), detail, alpha).alias("fused"))


def warp_to(raster: Raster, target: Raster, method: str = "cubic", offset: float = 0.0) -> Raster:
    """A raster in another's grid and system, with a shift of its heights."""
    px = warp.reproject(raster.px, raster.crs, raster.transform, target.crs, (target.transform, target.width, target.height), method, (raster.height, raster.width))
    return replace(target, px=px.select("r", "c", A.shifted(F.col("v"), offset).alias("v")))


def to_utm(raster: Raster, target: str = "EPSG:32629", method: str = "bilinear") -> Raster:
    """A raster in another system, on the grid that follows from its bounds."""
    spark = raster.px.sparkSession
    box = warp.bounds_in(spark.createDataFrame([(0, *raster.bounds)], "id int, left double, bottom double, right double, top double"), raster.crs, target).first()
    transform, width, height = warp.target_grid(box["left"], box["bottom"], box["right"], box["top"], raster.width, raster.height)
    return Raster(warp.reproject(raster.px, raster.crs, raster.transform, target, (transform, width, height), method, (raster.height, raster.width)), height, width, transform, target)


def ascii_mosaic(spark: SparkSession, path: str, crs: str | None = None) -> Raster:
    """ASCII grids of one cell size as one raster; where files overlap the first by name counts."""
    head = sources.ascii_header(spark, path)
    box = head.agg(F.min("left"), F.min("bottom"), F.max(F.col("left") + F.col("width") * F.col("cell")), F.max(F.col("bottom") + F.col("height") * F.col("cell")), F.min("cell"), F.max("cell")).first()
    left, bottom, right, top, cell, largest = box
    if largest - cell > 1e-9:
        raise ValueError(f"cell sizes differ: {cell} to {largest}")
    px = sources.ascii_pixels(spark, path).select(F.floor((top - F.col("y")) / cell).cast("bigint").alias("r"), F.floor((F.col("x") - left) / cell).cast("bigint").alias("c"), "v", F.col("path").alias("file_rank"))
    return Raster(joins.mosaic_first(px).select("r", "c", "v"), round((top - bottom) / cell), round((right - left) / cell), (cell, 0.0, left, 0.0, -cell, top), crs or "EPSG:2157")


def ascii_to_utm(spark: SparkSession, path: str, projections: str | None = None, offset: float = 0.0, target: str = "EPSG:32629") -> Raster:
    """ASCII grids to a raster in UTM, with the datum shift where wanted; .prj files name the system, which must be one."""
    crs = None
    if projections is not None:
        named = [r["crs"] for r in sources.projection(spark, projections).select("crs").distinct().limit(2).collect()]
        if len(named) > 1:
            raise ValueError(f"several systems: {sorted(named)}")
        crs = named[0] if named else None
    out = to_utm(ascii_mosaic(spark, path, crs), target)
    return replace(out, px=out.px.select("r", "c", A.shifted(F.col("v"), offset).alias("v")))


def valid_part(raster: Raster, margin: int = 0) -> Raster:
    """Cropped to the box of its valid pixels, with a margin within the raster."""
    b = stats.valid_bbox(raster.px).first()  # one row
    if not b["n_valid"]:
        return replace(raster, px=raster.px.limit(0), height=0, width=0)
    r0, r1 = max(0, b["row_min"] - margin), min(raster.height, b["row_max"] + margin)
    c0, c1 = max(0, b["col_min"] - margin), min(raster.width, b["col_max"] + margin)
    px = raster.px.filter(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "v")
    return Raster(px, r1 - r0, c1 - c0, G.window_transform(raster.transform, c0, r0), raster.crs)


def bicubic_matched(fusion: Raster, coarse: Raster, offset: float = 58.0) -> Raster:
    """A coarse terrain model, cut to the valid part of the fused one, shifted, and resampled to the fused one's grid."""
    part = read_window(coarse, valid_part(fusion).bounds)
    full = on_grid(part.px, part.height, part.width).select("r", "c", A.shifted(F.col("v"), offset).alias("v"))
    mean = F.broadcast(full.agg(F.avg("v").alias("mean")))
    filled = full.crossJoin(mean).select("r", "c", F.coalesce("v", "mean").alias("v"))
    px = focal.resize_cubic(focal.resize_cubic(filled, "r", part.height, fusion.height), "c", part.width, fusion.width)
    return replace(fusion, px=px)


def points_of(raster: Raster) -> DataFrame:
    """The valid pixels as points (id, x, y, z) in the world, at their centres."""
    x, y = F.lit(raster.transform[2]) + (F.col("c") + 0.5) * raster.transform[0], F.lit(raster.transform[5]) + (F.col("r") + 0.5) * raster.transform[4]
    return raster.px.filter(F.col("v").isNotNull()).select((F.col("r") * raster.width + F.col("c")).alias("id"), x.alias("x"), y.alias("y"), F.col("v").alias("z"))


def _kriged(points: DataFrame, target: Raster, model: str, size: int, halo: int, radius: float | None) -> DataFrame:
    """Points of the world on the target's grid, in its pixels, kriged: (r, c, v, variance, n_blocks)."""
    a, _, c, _, e, f = target.transform
    local = points.select("id", ((F.col("x") - c) / a - 0.5).alias("x"), ((F.col("y") - f) / e - 0.5).alias("y"), "z").checkpoint()
    fit = geostat.fit_variogram(local, model)
    return geostat.krige_scene(local, fit, target.height, target.width, size, halo, None if radius is None else radius / abs(a))


def run_kriging(coarse: Raster, target: Raster, model: str = "spherical", offset: float = 58.0, size: int = 1024, halo: int = 64, radius: float | None = None) -> DataFrame:
    """Every place of a fine grid from a coarse terrain model; radius in metres."""
    points = points_of(replace(coarse, px=coarse.px.select("r", "c", A.shifted(F.col("v"), offset).alias("v"))))
    return _kriged(points, target, model, size, halo, radius)


def run_masked_kriging(coarse: Raster, fusion: Raster, model: str = "spherical", offset: float = 58.0, margin: int = 100, size: int = 512, halo: int = 32, radius: float | None = None) -> tuple[DataFrame, Raster]:
    """The same on the fused model's valid part alone; with the pixels, the part's place."""
    part = valid_part(fusion, margin)
    near = read_window(coarse, part.bounds)
    return run_kriging(near, part, model, offset, size, halo, radius), part


def run_fusion_based_kriging(fusion: Raster, factor: int, model: str = "spherical", size: int = 512, halo: int = 32) -> tuple[DataFrame, DataFrame]:
    """The fused model from its own pixels on a grid `factor` times coarser, with the search radius of their density; and its errors against the fused model.

    As in the procedure that this follows, a value that decimation took from a
    coarse pixel's corner stands at its centre, (factor - 1) / 2 pixels away.
    """
    coarse = Raster(stats.decimate(fusion.px, factor), -(-fusion.height // factor), -(-fusion.width // factor), G.decimated(fusion.transform, factor), fusion.crs)
    out = _kriged(points_of(coarse), fusion, model, size, halo, None)
    both = joins.coregister(out.select("r", "c", "v"), fusion.px, ("kriged", "fused"))
    return out, both.agg(*stats.error_metrics(F.col("kriged") - F.col("fused")))


# validation and comparison


def clean(dsm: DataFrame, dtm: DataFrame, max_height: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """The surface lifted to its terrain and without heights over max_height; with the counts before and after."""
    both = joins.coregister(dsm, dtm, ("dsm", "dtm"))
    lifted = A.repaired(F.col("dsm"), F.col("dtm"))
    out = both.withColumn("v", F.when(F.col("dtm").isNull() | (lifted - F.col("dtm") <= max_height), lifted))
    before, after = F.col("dsm") - F.col("dtm"), F.col("v") - F.col("dtm")
    counts = [F.count_if(x < -0.1).alias(f"violations_{n}") for n, x in (("before", before), ("after", after))] + [F.count_if(x > max_height).alias(f"tall_{n}") for n, x in (("before", before), ("after", after))]
    return out.select("r", "c", "v"), out.agg(*counts, F.count("v").alias("n"), A.tidy(F.avg("v")).alias("mean"))


def validate_all(dsm: Raster, dtm: Raster) -> DataFrame:
    """V1-V9: findings (check, severity, metric) on the files, their alignment and their common pixels; passes() gives the verdict."""
    loaded = dsm.px.agg(F.count("v").alias("n")).select(F.lit("dsm_loads").alias("check"), "n").unionByName(dtm.px.agg(F.count("v").alias("n")).select(F.lit("dtm_loads").alias("check"), "n"))
    loaded = loaded.select("check", F.when(F.col("n") > 0, "passed").otherwise("issue").alias("severity"), F.col("n").cast("double").alias("metric"))
    pair = joins.coregister(dsm.px, dtm.px, ("dsm", "dtm"))
    heights = pair.select((F.col("dsm") - F.col("dtm")).alias("v"))
    rows = validate.meta_findings(dsm.meta(), dtm.meta()).unionByName(validate.findings(validate.metrics(pair)))
    return loaded.unionByName(rows).unionByName(validate.outlier_finding(stats.iqr_outliers(heights, "v"), "outliers"))


def align_and_validate(dsm: Raster, dtm: Raster) -> tuple[Raster, Raster, DataFrame, DataFrame]:
    """Both cropped to their common size where it differs; findings, and a row (valid, issues, warnings)."""
    h, w = min(dsm.height, dtm.height), min(dsm.width, dtm.width)
    crop = lambda x: x if (x.height, x.width) == (h, w) else replace(x, px=x.px.filter((F.col("r") < h) & (F.col("c") < w)), height=h, width=w)
    a, b = crop(dsm), crop(dtm)
    found = validate_all(a, b)
    return a, b, found, validate.passes(found)


#: Largest |mean difference| and RMSE of each tier of agreement.
COARSE_TIERS = (("excellent", 0.30, 0.50), ("good", 0.50, 1.00))
OVERLAP_TIERS = (("excellent", 0.30, 0.50), ("good", 2.0, 3.0))


def _tier(tiers: tuple, datum: bool) -> Column:
    out = F.when(F.abs("mean_diff").between(50, 62) & (F.col("std_diff") < 10), "datum_offset") if datum else None
    for name, bias, rmse in tiers:
        rule = (F.abs("mean_diff") < bias) & (F.col("rmse") < rmse)
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("poor")


def _compared(a: DataFrame, b: DataFrame, tiers: tuple, datum: bool) -> DataFrame:
    d = F.col("a") - F.col("b")
    both = joins.coregister(a, b).filter(d.isNotNull())
    m = both.agg(A.tidy(F.avg(d)).alias("mean_diff"), A.tidy(F.sqrt(F.avg(d * d))).alias("rmse"), A.tidy(F.avg(F.abs(d))).alias("mae"), A.tidy(F.stddev_pop(d)).alias("std_diff"), F.count("*").alias("blocks_compared"))
    return m.filter("blocks_compared > 0").withColumn("is_datum_offset", F.abs("mean_diff").between(50, 62) & (F.col("std_diff") < 10)).withColumn("agreement", _tier(tiers, datum))


def _block_means(raster: Raster, k: int) -> DataFrame:
    return stats.block_mean(raster.px, raster.height, raster.width, k).select(F.col("block_row").cast("bigint").alias("r"), F.col("block_col").cast("bigint").alias("c"), F.col("mean").alias("v"))


def coarse_comparison(fine: Raster, coarse: Raster, scale: float = 10.0) -> DataFrame:
    """Means of blocks of `scale` metres beside a coarse raster's pixels of the same number; no row if none is valid in both."""
    return _compared(_block_means(fine, int(scale / abs(fine.transform[0]))), coarse.px, COARSE_TIERS, False)


def overlap(a: Raster, b: Raster) -> tuple[float, float, float, float] | None:
    """J7 of two rasters: their common bounds; in the first one's system."""
    x, y = a.bounds, b.bounds
    if a.crs != b.crs:
        box = warp.bounds_in(b.px.sparkSession.createDataFrame([(0, *y)], "id int, left double, bottom double, right double, top double"), b.crs, a.crs).first()
        y = box["left"], box["bottom"], box["right"], box["top"]
    left, bottom, right, top = max(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), min(x[3], y[3])
    return (left, bottom, right, top) if left < right and bottom < top else None


def overlap_comparison(a: Raster, b: Raster, scale: float = 10.0) -> DataFrame:
    """Where two rasters of one system overlap, block means of the first beside those of the second in proportion."""
    if a.crs != b.crs:
        raise ValueError(f"{a.crs} and {b.crs} differ: reproject one of them")
    common = overlap(a, b)
    if common is None:
        raise ValueError("the rasters do not overlap")
    x, y = read_window(a, common), read_window(b, common)
    k = int(scale / abs(a.transform[0]))
    h, w = x.height // k, x.width // k
    r, c = stats.proportional_index(F.col("r"), y.height, h), stats.proportional_index(F.col("c"), y.width, w)
    means = y.px.groupBy(r.alias("r"), c.alias("c")).agg(F.avg("v").alias("v"))
    return _compared(_block_means(x, k), means, OVERLAP_TIERS, True)


def debug_comparison(a: Raster, b: Raster) -> DataFrame:
    """Findings on what may spoil a comparison of two rasters."""
    spark = a.px.sparkSession
    common = overlap(a, b)
    box = a.bounds
    pct = 100.0 * (common[2] - common[0]) * (common[3] - common[1]) / ((box[2] - box[0]) * (box[3] - box[1])) if common else 0.0
    rows = [
        ("crs", "passed" if a.crs == b.crs else "issue", 0.0),
        ("a_projected", "issue" if warp.is_geographic(a.crs) else "passed", 0.0),
        ("b_projected", "issue" if warp.is_geographic(b.crs) else "passed", 0.0),
        ("overlap", "passed" if common else "issue", round(pct, 6)),
    ]
    found = spark.createDataFrame(rows, "check string, severity string, metric double")
    for name, raster in (("a", a), ("b", b)):
        s = raster.px.agg(F.avg("v").alias("m"), F.count("v").alias("n"))
        sane = F.when((F.col("n") == 0) | A.implausible_mean(F.col("m")), "issue").otherwise("passed")
        found = found.unionByName(s.select(F.explode(F.array(F.struct(F.lit(f"{name}_elevation").alias("check"), sane.alias("severity"), A.tidy(F.col("m")).alias("metric")), F.struct(F.lit(f"{name}_nodata").alias("check"), F.when(F.col("n") == 0, "issue").otherwise("passed").alias("severity"), F.col("n").cast("double").alias("metric")))).alias("f")).select("f.*"))
    return found


def coverage(px: DataFrame) -> DataFrame:
    """Counts, the valid box, how full it is, and the status tiers of both."""
    v = F.col("v")
    m = px.agg(F.count("*").alias("total"), F.count(v).alias("n_valid"), *[f(F.when(v.isNotNull(), F.col(x))).alias(f"{x}_{n}") for x in ("r", "c") for n, f in (("min", F.min), ("max", F.max))])
    cells = (F.col("r_max") - F.col("r_min") + 1) * (F.col("c_max") - F.col("c_min") + 1)
    pct, fill = A.share(F.col("n_valid"), F.col("total")), A.share(F.col("n_valid"), cells)
    return m.select("*", A.tidy(pct).alias("coverage_pct"), A.tidy(fill).alias("fill_pct"), A.coverage_tier(pct, A.KRIGED_TIERS).alias("status"), A.coverage_tier(fill, A.BOX_TIERS).alias("box_status"))


def preflight(manifest: DataFrame, files: DataFrame, rasters: dict[str, Raster], n_tiles: int, every: int = 100) -> DataFrame:
    """Findings on files, sampled coverage, systems, resolutions and the work list."""
    spark = manifest.sparkSession
    there = sources.probe(manifest, files).select(F.concat(F.lit("file:"), "path").alias("check"), F.when(F.col("present"), "passed").otherwise("issue").alias("severity"), F.col("length").cast("double").alias("metric"))
    steps = [abs(x.transform[0]) for x in rasters.values()]
    spread, systems = max(steps) - min(steps), len({x.crs for x in rasters.values()})
    rows = [
        ("crs", "passed" if systems == 1 else "issue", float(systems)),
        ("resolution", "passed" if spread <= 0.001 else "warning", spread),
        ("tiles", "passed" if n_tiles >= 10 else "issue", float(n_tiles)),
    ]
    found = there.unionByName(spark.createDataFrame(rows, "check string, severity string, metric double"))
    for name, raster in rasters.items():
        pct = A.share(F.count("v"), F.count("*"))
        s = stats.decimate(raster.px, every).agg(pct.alias("pct")).select(F.lit(f"coverage:{name}").alias("check"), F.when(F.coalesce(F.col("pct"), F.lit(0.0)) < 10, "issue").when(F.col("pct") < 80, "warning").otherwise("passed").alias("severity"), A.tidy(F.col("pct")).alias("metric"))
        found = found.unionByName(s)
    return found


def compare_methods(px: DataFrame, n_methods: int, reference: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of each method on the pixels valid in all, and of each against the reference."""
    common = joins.common_pixels(px, n_methods)
    each = stats.summary(common, "v", "method")
    d = F.col("v") - F.col("ref")
    pairs = joins.against_reference(common, reference).groupBy("method").agg(F.count("*").alias("n"), A.tidy(F.avg(d)).alias("mean_diff"), A.tidy(F.stddev_pop(d)).alias("std_diff"), A.tidy(F.sqrt(F.avg(d * d))).alias("rmse"), A.tidy(F.max(F.abs(d))).alias("max_abs"), A.tidy(stats.safe_corr("v", "ref")).alias("correlation"))
    return each, pairs


def analysis(depths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Performance of each method, and all eleven columns of the pairwise comparison with its significance."""
    pairs = stats.method_pairs(depths)
    full = stats.pair_statistics(pairs).join(geostat.pair_pvalues(pairs).drop("n_tiles"), ["method_1", "method_2"])
    return stats.method_performance(depths), full.withColumn("significance", A.significance(F.col("ttest_p")))
