"""One GeoTIFF from many tasks, and what a filter leaves to be read."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import blockwise
from thalweg.operators.composites import Raster, load_raster, save_raster
from thalweg.sources import blocks, geotiff

T = (0.5, 0.0, 100.0, 0.0, -0.5, 900.0)


def frame(spark, array):
    rows = [(r, c, None if v != v else float(v)) for r, row in enumerate(array.tolist()) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "r bigint, c bigint, v double").repartition(7)


def rough(h, w, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(100, 5, (h, w)).astype(np.float32).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x


def back(px, shape):
    out = np.full(shape, np.nan)
    for r in px.collect():
        if r["v"] is not None:
            out[r["r"], r["c"]] = r["v"]
    return out


@pytest.mark.parametrize("big, predictor", [("auto", 1), ("true", 3), ("false", 3)])
def test_round_trip(spark, tmp_path, big, predictor):
    x = rough(75, 50)
    x[16:48, 16:32] = np.nan  # whole tiles that nobody writes
    path = str(tmp_path / "out.tif")
    save_raster(Raster(frame(spark, x), 75, 50, T, "EPSG:32629"), path, 16, big=big, predictor=predictor)
    assert os.listdir(tmp_path) == ["out.tif"]
    m = geotiff.described(path)
    assert (m["height"], m["width"], m["transform"], m["crs"], m["bands"]) == (75, 50, T, "EPSG:32629", 1)
    got = load_raster(spark, path)
    np.testing.assert_array_equal(back(got.px, x.shape), x)
    part = load_raster(spark, path, window=(10, 20, 40, 99))
    assert (part.height, part.width) == (30, 30)
    np.testing.assert_array_equal(back(part.px, (30, 30)), x[10:40, 20:50])
    with open(path, "rb") as f:
        assert f.read(4)[2] == (43 if big == "true" else 42)


def test_bands_overwrite_and_exists(spark, tmp_path):
    x, path = [rough(40, 33, k) for k in range(3)], str(tmp_path / "rgb.tif")
    grid = blockwise.Grid(40, 33, 16)
    rows = None
    for k, a in enumerate(x):
        one = blockwise.raster_blocks(blockwise.pack(frame(spark, a), grid), grid, "rgb", k + 1)
        rows = one if rows is None else rows.union(one)
    geotiff.save(rows, path, 40, 33, 16, T, bands=3)
    for k, a in enumerate(x):
        px = blocks.pixels(spark.read.format("geotiff").load(path).filter(F.col("band") == k + 1)).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))
        np.testing.assert_array_equal(back(px, a.shape), a)
    geotiff.save(rows.filter("band = 1"), path, 40, 33, 16, T)  # in its place
    assert geotiff.described(path)["bands"] == 1
    with pytest.raises(Exception, match="FileExists"):
        geotiff.save(rows.filter("band = 1"), path, 40, 33, 16, T, mode="append")


def test_failed_task_leaves_nothing(spark, tmp_path):
    grid = blockwise.Grid(64, 64, 16)
    rows = blockwise.raster_blocks(blockwise.pack(frame(spark, rough(64, 64)), grid), grid, "x")
    broken = rows.withColumn("h", F.when(F.expr("block_row = 3 and block_col = 3"), F.raise_error(F.lit("lost"))).otherwise(F.col("h")))
    with pytest.raises(Exception, match="lost"):
        geotiff.save(broken, str(tmp_path / "out.tif"), 64, 64, 16, T)
    assert os.listdir(tmp_path) == []
    for wrong, match in ((rows.union(rows.filter("block_row = 0")), "twice"), (rows.withColumn("row0", F.col("row0") + 1), "fit")):
        with pytest.raises(Exception, match=match):
            geotiff.save(wrong, str(tmp_path / "out.tif"), 64, 64, 16, T)
        assert os.listdir(tmp_path) == []


def test_larger_than_the_drivers_buffers(spark, tmp_path):
    """Pixels made by Spark go into the file and come back without being gathered: 4 million of them, sums by tile agree."""
    side, tile = 2048, 256
    px = spark.range(side * side, numPartitions=8).select(F.expr(f"id div {side}").alias("r"), (F.col("id") % side).alias("c"), (F.col("id") % 1021).cast("double").alias("v"))
    path = str(tmp_path / "large.tif")
    save_raster(Raster(px, side, side, T), path, tile)
    again = blocks.pixels(spark.read.format("geotiff").load(path))
    sums = lambda df, r, c, v: {(x["a"], x["b"]): (x["s"], x["n"]) for x in df.groupBy(F.expr(f"{r} div {tile}").alias("a"), F.expr(f"{c} div {tile}").alias("b")).agg(F.sum(v).alias("s"), F.count(v).alias("n")).collect()}
    assert sums(again, "row", "col", "value") == sums(px, "r", "c", "v")


def test_pushed_filters(spark, tmp_path):
    """Only strips and tiles that a filter leaves are partitions; what can't be pushed is still filtered."""
    tiles, strips = str(tmp_path / "tiles.tif"), str(tmp_path / "strips.tif")
    x = rough(64, 48)
    save_raster(Raster(frame(spark, x), 64, 48, T), tiles, 16)
    geotiff.write_strip_tiff(strips, np.dstack([x, x + 1]), T, rows_per_strip=8)
    geotiff.register(spark)
    read = lambda p: spark.read.format("geotiff").load(p)
    assert read(tiles).rdd.getNumPartitions() == 12
    one = read(tiles).filter("row0 >= 32 and row0 < 48 and col0 = 16")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert read(tiles).filter("block_row in (0, 3) and w = 16 and size(data) > 0").rdd.getNumPartitions() == 6
    assert read(tiles).filter("block_row in (0, 3) and row0 + h > 60").count() == 3
    band = read(strips).filter("band = 2 and row0 < 16")
    assert band.rdd.getNumPartitions() == 2 and {r["band"] for r in band.collect()} == {2}
    both = read(str(tmp_path / "*.tif"))
    assert both.rdd.getNumPartitions() == 12 + 8 and both.filter("raster_id = 'tiles.tif'").rdd.getNumPartitions() == 12
    assert read(str(tmp_path)).count() == 12 + 16 and read(f"file://{tiles}").count() == 12
    assert spark.read.format("geotiff").load([tiles, strips]).count() == 28
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    spark.dataSource.register(geotiff.GeoTiffSource)  # filters apply without being pushed, too
    assert read(tiles).filter("row0 >= 32 and row0 < 48 and col0 = 16").count() == 1
    with pytest.raises(Exception, match="no GeoTIFF"):
        read(str(tmp_path / "none*.tif")).count()
