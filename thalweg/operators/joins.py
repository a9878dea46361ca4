"""Joins on place (J1-J19). Range and radius conditions become equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import sliding_tiles
from ..functions.names import tile_number


def coregister(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pixels (r, c, v) of two rasters where both exist; the inner join is the crop."""
    return a.select("r", "c", F.col("v").alias(names[0])).join(b.select("r", "c", F.col("v").alias(names[1])), ["r", "c"])


def gather(px: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """A raster's pixels at the places of a mask."""
    return px.join(mask.select(*keys).distinct(), list(keys), "left_semi")


def align_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels kept, and removed from either raster, by one pass over both."""
    marks = a.select("r", "c", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select("r", "c", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    each = marks.groupBy("r", "c").agg(F.max("in_a").alias("a"), F.max("in_b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("kept"), F.count_if(F.col("b") == 0).alias("removed_a"), F.count_if(F.col("a") == 0).alias("removed_b"))


def common_pixels(px: DataFrame, n_methods: int) -> DataFrame:
    """Pixels (method, r, c, v) valid in all methods."""
    every = px.groupBy("r", "c").agg(F.count("v").alias("n")).filter(F.col("n") == n_methods).select("r", "c")
    return px.join(every, ["r", "c"], "left_semi")


def crop_to(px: DataFrame, box: DataFrame, margin: int = 0) -> DataFrame:
    """Pixels in the valid box (one row, broadcast) with a margin."""
    inside = F.col("r").between(F.col("row_min") - margin, F.col("row_max") - 1 + margin) & F.col("c").between(F.col("col_min") - margin, F.col("col_max") - 1 + margin)
    return px.crossJoin(F.broadcast(box)).filter(inside).select(*px.columns)


def bbox_overlap(boxes: DataFrame, size: float) -> DataFrame:
    """Pairs id_a < id_b of boxes (id, left, bottom, right, top) that overlap.

    Boxes are put into square cells of `size`; a pair counts in the cell of its
    overlap's lower left corner alone.
    """
    cell = lambda x: F.floor(F.col(x) / size).cast("bigint")
    cells = boxes.withColumn("cx", F.explode(F.sequence(cell("left"), cell("right")))).withColumn("cy", F.explode(F.sequence(cell("bottom"), cell("top"))))
    a = cells.select("cx", "cy", *[F.col(c).alias(f"{c}_a") for c in ("id", "left", "bottom", "right", "top")])
    b = cells.select("cx", "cy", *[F.col(c).alias(f"{c}_b") for c in ("id", "left", "bottom", "right", "top")])
    both = a.join(b, ["cx", "cy"]).filter("id_a < id_b and left_a < right_b and left_b < right_a and bottom_a < top_b and bottom_b < top_a")
    both = both.withColumns({"left": F.greatest("left_a", "left_b"), "right": F.least("right_a", "right_b"), "bottom": F.greatest("bottom_a", "bottom_b"), "top": F.least("top_a", "top_b")})
    return both.filter((F.col("cx") == cell("left")) & (F.col("cy") == cell("bottom"))).select("id_a", "id_b", "left", "right", "bottom", "top", ((F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))).alias("area"))


def assign_tiles(px: DataFrame, rows: int, cols: int, tile: int, stride: int) -> DataFrame:
    """Each pixel once for each tile that holds it, four at most."""
    by_row = px.withColumn("tile_row", F.explode(sliding_tiles(F.col("r"), rows, tile, stride)))
    both = by_row.withColumn("tile_col", F.explode(sliding_tiles(F.col("c"), cols, tile, stride)))
    return both.withColumn("tile", (F.col("tile_row") * cols + F.col("tile_col")).cast("bigint"))


def neighbours(centres: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y, z) within `radius` of centres (block, cx, cy), by buckets of that size."""
    bucket = lambda x: F.floor(x / radius).cast("bigint")
    around = F.sequence(F.lit(-1), F.lit(1))
    c = centres.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    c = c.withColumn("bx", bucket(F.col("cx")) + F.col("i")).withColumn("by", bucket(F.col("cy")) + F.col("j")).drop("i", "j")
    p = points.withColumn("bx", bucket(F.col("x"))).withColumn("by", bucket(F.col("y")))
    dist = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    return c.join(p, ["bx", "by"]).drop("bx", "by").withColumn("dist", dist).filter(F.col("dist") <= radius)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each block, ties by id; the rank limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy("block").orderBy("dist", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def mosaic_first(px: DataFrame) -> DataFrame:
    """Of overlapping files the first valid value by file_rank."""
    return px.filter(F.col("v").isNotNull()).groupBy("r", "c").agg(F.min_by("v", "file_rank").alias("v"), F.min("file_rank").alias("file_rank"))


def candidate_tiles(centres: DataFrame, others: DataFrame, rows: int, cols: int, reach: int = 5) -> DataFrame:
    """The tiles (tile) within `reach` rows and columns of numbers about each centre that are in the grid, and others, once each.

    As tile numbers are counted on, a neighbour beyond the end of a row is the next row's first tile.
    """
    around = F.sequence(F.lit(-reach), F.lit(reach))
    near = centres.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select((F.col("tile") + F.col("i") * cols + F.col("j")).cast("bigint").alias("tile"))
    return near.filter(F.col("tile").between(0, rows * cols - 1)).union(others.select(F.col("tile").cast("bigint"))).distinct()


def file_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """One image and one mask a tile, the last by name (R10), and how many there were."""
    one = lambda f, name: f.groupBy("tile_num").agg(F.max("file").alias(name), F.count("*").alias(f"n_{name}"))
    return one(images, "image").join(one(masks, "mask"), "tile_num")


def tiles_with_masks(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Tiles (tile_num) for which some mask file (file) has that number."""
    return tiles.join(files.select(tile_number(F.col("file")).alias("tile_num")), "tile_num", "left_semi")


def missing(wanted: DataFrame, there: DataFrame, on: str) -> DataFrame:
    """J16."""
    return wanted.join(there, on, "left_anti")


def against_reference(px: DataFrame, reference: str) -> DataFrame:
    """Every other method's pixels beside the reference's."""
    ref = px.filter(F.col("method") == reference).select("r", "c", F.col("v").alias("ref"))
    return px.filter(F.col("method") != reference).join(ref, ["r", "c"])


def availability(a: Column, b: Column) -> Column:
    """P24."""
    return F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")
