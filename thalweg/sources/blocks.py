"""Raster blocks: the storage form, and its pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1-K4: Parquet, a folder for each raster; blocks are immutable, updates write anew."""
    blocks.write.mode(mode).partitionBy("raster_id").parquet(path)


def read_blocks(spark: SparkSession, path: str, raster_id: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Blocks of a raster that touch the window (row0, col0, row1, col1); folders and row groups are pruned."""
    out = spark.read.parquet(path)
    if raster_id is not None:
        out = out.filter(F.col("raster_id") == raster_id)
    if window is not None:
        r0, c0, r1, c1 = window
        out = out.filter((F.col("row0") < r1) & (F.col("row0") + F.col("h") > r0) & (F.col("col0") < c1) & (F.col("col0") + F.col("w") > c0))
    return out


def pixels(blocks: DataFrame, window: tuple[int, int, int, int] | None = None, nodata: float | None = None) -> DataFrame:
    """raster_pixel rows of blocks; nodata and NaN are null."""
    v = F.col("value")
    out = blocks.select("raster_id", "band", "row0", "col0", "w", F.posexplode("data").alias("pos", "value"))
    out = out.select("raster_id", "band", (F.col("row0") + F.floor(F.col("pos") / F.col("w"))).cast("int").alias("row"), (F.col("col0") + F.col("pos") % F.col("w")).cast("int").alias("col"), F.when(~F.isnan(v) & (F.lit(True) if nodata is None else v != nodata), v).alias("value"))
    if window is not None:
        r0, c0, r1, c1 = window
        out = out.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return out


def overlaid(px: DataFrame, changes: DataFrame) -> DataFrame:
    """K4: pixels with those of `changes` (raster_id, band, row, col, value) in their place, to be written anew."""
    new = changes.select("raster_id", "band", "row", "col", F.col("value").alias("_new"), F.lit(True).alias("_changed"))
    return px.join(new, ["raster_id", "band", "row", "col"], "left").select("raster_id", "band", "row", "col", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def bands(px: DataFrame, numbers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(raster_id, row, col) with a column b<number> for each band."""
    return px.groupBy("raster_id", "row", "col").pivot("band", list(numbers)).agg(F.first("value")).select("raster_id", "row", "col", *[F.col(str(n)).alias(f"b{n}") for n in numbers])


def centre(blocks: DataFrame, height: int, width: int, half: int = 500) -> DataFrame:
    """Pixels of the square around the middle."""
    return pixels(blocks, (height // 2 - half, width // 2 - half, height // 2 + half, width // 2 + half))


def to_blocks(px: DataFrame, size: int = 256) -> DataFrame:
    """Pixels (raster_id, band, row, col, value) gathered into blocks of size x size; a block is bounded."""
    keyed = px.withColumn("block_row", F.floor(F.col("row") / size).cast("int")).withColumn("block_col", F.floor(F.col("col") / size).cast("int"))
    g = keyed.groupBy("raster_id", "band", "block_row", "block_col").agg(F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"), F.map_from_entries(F.collect_list(F.struct((F.col("row") * 1000000 + F.col("col")).cast("bigint"), F.col("value").cast("float")))).alias("m"))
    place = lambda i: (F.col("row0") + F.floor(i / F.col("w")).cast("int")).cast("bigint") * 1000000 + F.col("col0") + i % F.col("w")
    return g.select("raster_id", "band", "block_row", "block_col", "row0", "col0", "h", "w", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.try_element_at("m", place(i))).alias("data"))
