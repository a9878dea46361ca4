"""Hand-made rasters and properties of the reference's operators."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import algebra as A
from thalweg.functions import grid as G
from thalweg.functions import names
from thalweg.operators import focal, geostat, joins, stats, validate, vision, warp
from thalweg.sources import blocks, files, geotiff


def raster(spark, rows):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "r bigint, c bigint, v double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        if x.v is not None:
            out[x.r, x.c] = x.v
    return out


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("v, inside", [(-0.1, False), (0, False), (0.0001, True), (4.9999, True), (5, False)])
def test_depth_bounds(spark, v, inside):
    assert one(spark, A.physical(F.col("d")), d=v) is inside
    assert one(spark, A.physical(F.col("d"), 10.0), d=v) is (v > 0)


def test_nulls(spark):
    assert one(spark, A.masked(F.col("d")), d=-9999) is None and one(spark, A.masked(F.col("d")), d=float("nan")) is None
    assert one(spark, A.clipped(F.col("d"), 0, 50), d=None) is None and one(spark, A.clamp_negative(F.col("d")), d=None) is None
    assert one(spark, A.clipped(F.col("d"), 0.0, 50.0), d=70) == 50 and one(spark, A.share(F.col("d"), F.lit(0)), d=1) is None


def test_algebra(spark):
    pair = spark.createDataFrame([(5.0, 3.0), (2.0, 3.0), (None, 1.0), (60.0, 1.0)], "dsm double, dtm double")
    assert [r.x for r in pair.select(A.ndsm(F.col("dsm"), F.col("dtm")).alias("x")).collect()] == [2, 0, None, 59]
    assert [r.x for r in pair.select(A.repaired(F.col("dsm"), F.col("dtm")).alias("x")).collect()] == [5, 3, None, 60]
    assert one(spark, A.fused(F.col("d"), F.lit(9.0), F.lit(0.0)), d=4) == 4
    assert [one(spark, A.height_class(F.col("d")), d=v) for v in (-1, 0, 2, 99, 100)] == [0, 1, 2, 5, 6]
    assert one(spark, A.agreement(F.col("d"), F.lit(58.0), F.lit(1.0)), d=-58) == "datum_offset"


def test_tile_numbers(spark):
    assert G.grid_size(63600, 39453) == (51, 82)
    t = {r.tile_number: r for r in G.tile_grid(spark, 63600, 39453).filter(F.col("tile_number").isin(0, 50, 156, 359, 4181)).collect()}
    assert {k: (r.grid_row, r.grid_col, r.pixel_row, r.pixel_col) for k, r in t.items()} == {0: (0, 0, 0, 0), 50: (0, 50, 0, 38400), 156: (1, 74, 768, 56832), 359: (4, 31, 3072, 23808), 4181: (50, 81, 38400, 62208)}
    with pytest.raises(ValueError):
        G.tile_grid(spark, 2000, 2000, transform=(1, 0.1, 0, 0, -1, 0))


def test_windows(spark):
    t = (0.5, 0, 100, 0, -0.5, 200)
    w = spark.range(1).select(*[x.alias(n) for x, n in zip(G.window_of(F.lit(101.1), F.lit(190.0), F.lit(105.0), F.lit(199.0), t), "abcd", strict=True)]).first()
    assert tuple(w) == (2, 2, 8, 18)
    assert G.window_transform(t, 2, 4) == (0.5, 0, 101, 0, -0.5, 198) and G.decimated(t, 10)[0] == 5 and G.transform_of_bounds(0, 0, 10, 20, 5, 10) == (2, 0, 0, 0, -2, 20)
    assert one(spark, G.to_pixel(F.col("d"), F.lit(0.0), (1, 0, 0, 0, -1, 0))[1], d=-2.7) == -2


def test_names(spark):
    f = ["DJI_20250728101825_0553_V_patch_0359.jpg", "patch_0359.png", "tile_0359.jpg", "PATCH-12.png", "none.txt"]
    df = spark.createDataFrame([(x,) for x in f], "f string")
    assert [r.n for r in df.select(names.tile_number(F.col("f")).alias("n")).collect()] == [359, 359, 359, 12, None]
    assert [r.n for r in df.select(names.has_patch(F.col("f"), F.lit(359)).alias("n")).collect()] == [True, True, False, False, False]


def test_work_list(spark, tmp_path):
    text = "WORKING TILES\n=====\n\nTile 7: DSM 91.5%, DTM 80.0%\n  Image: a.jpg\n  Mask:  a.png\n\nTile 8: DSM 1.0%, DTM 2.0%\n  Mask:  b.png\n\nTile 12: DSM 5.0%, DTM 6.0%\n  Image: c d.jpg\n  Mask:  c.png\n"
    (tmp_path / "w.txt").write_text(text)
    rows = files.work_list(spark, str(tmp_path / "w.txt")).orderBy("tile_num").collect()
    assert [(r.tile_num, r.dsm_pct, r.dtm_pct, r.image_file, r.mask_file) for r in rows] == [(7, 91.5, 80.0, "a.jpg", "a.png"), (12, 5.0, 6.0, "c d.jpg", "c.png")]
    assert files.work_list_size(spark, str(tmp_path / "w.txt")) == 3


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    rows = {(r.r, r.c): (r.x, r.y, r.v) for r in files.ascii_pixels(spark, str(tmp_path / "g.asc")).collect()}
    assert len(rows) == 6 and rows[0, 0] == (12.5, 27.5, 1) and rows[1, 1] == (17.5, 22.5, None) and rows[1, 2] == (22.5, 22.5, 6)
    (tmp_path / "g.prj").write_text('PROJCS["IRENET95 / Irish Transverse Mercator",AUTHORITY["EPSG","2157"]]')
    assert files.projection(spark, str(tmp_path / "g.prj")).first().crs == "EPSG:2157"
    assert files.listing(spark, str(tmp_path), "*.asc").count() == 1
    manifest = spark.createDataFrame([(r.path,) for r in files.listing(spark, str(tmp_path)).collect()] + [("x",)], "path string")
    assert sorted(r.present for r in files.probe(manifest, files.listing(spark, str(tmp_path))).collect()) == [False, True, True]


def png(path, rows, channels=1):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(sum((list(v) if channels == 3 else [v] for v in row), [])) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "i").mkdir()
    png(tmp_path / "m" / "patch_0359.png", [[0, 127, 128, 255], [1, 200, 0, 0]])
    png(tmp_path / "i" / "a.png", [[(10, 20, 30), (1, 2, 3)]], 3)
    got = {(r.tile_number, r.r, r.c) for r in files.masks(spark, str(tmp_path / "m")).collect()}
    assert got == {(359, 0, 2), (359, 0, 3), (359, 1, 1)}
    rgb = files.rgb_pixels(spark, str(tmp_path / "i")).orderBy("c").collect()
    assert [(r.red, r.green, r.blue) for r in rgb] == [(10, 20, 30), (1, 2, 3)]


def test_gauge(spark, tmp_path):
    (tmp_path / "g.csv").write_text("#Date,Waterlevel in mAOD\n16/02/2026,43.1 - 43.5\n22/10/2025,\n")
    assert [(str(r.date), r.level_min, r.level_max) for r in files.gauge(spark, str(tmp_path / "g.csv")).collect()] == [("2026-02-16", 43.1, 43.5), ("2025-10-22", None, None)]


@pytest.mark.parametrize("deflate, predictor", [(False, 1), (True, 1), (True, 3)])
def test_geotiff(spark, tmp_path, deflate, predictor):
    data = np.random.default_rng(1).normal(100, 10, (37, 23)).astype(np.float32).astype(float)
    data[3, 4] = np.nan
    path, t = str(tmp_path / "x.tif"), (2.0, 0.0, 500.0, 0.0, -2.0, 900.0)
    geotiff.write_strip_tiff(path, data, t, deflate=deflate, predictor=predictor, rows_per_strip=10)
    assert geotiff.metadata(path) == {"width": 23, "height": 37, "transform": t, "nodata": -9999.0}
    spark.dataSource.register(geotiff.GeoTiffSource)
    got = blocks.pixels(spark.read.format("geotiff").load(path)).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))
    assert np.array_equal(grid(got, (37, 23)), data, equal_nan=True)
    assert spark.read.format("geotiff").option("window", "0,0,5,5").load(path).count() == 1


def test_blocks(spark, tmp_path):
    px = spark.range(30 * 20).select(F.lit("a").alias("raster_id"), F.lit(1).alias("band"), F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") != 7, F.col("id").cast("float")).alias("value"))
    blocks.write_blocks(blocks.to_blocks(px, 8), str(tmp_path / "b"))
    back = blocks.pixels(blocks.read_blocks(spark, str(tmp_path / "b"), "a"))
    assert back.select("row", "col", "value").exceptAll(px.select("row", "col", "value")).count() == 0 and back.count() == 600
    assert blocks.pixels(blocks.read_blocks(spark, str(tmp_path / "b"), "a", (0, 0, 9, 5)), (0, 0, 9, 5)).count() == 45


def test_crop_and_align(spark):
    a, b = raster(spark, [[1] * 5] * 4), raster(spark, [[2] * 4] * 5)
    assert joins.coregister(a, b).count() == 16
    assert tuple(joins.align_report(a, b).first()) == (16, 4, 4)
    c = raster(spark, [[None, None, None], [None, 1, None], [None, None, 2]])
    box = stats.valid_bbox(c)
    assert tuple(box.first())[:4] == (1, 3, 1, 3)
    once = joins.crop_to(c, box)
    assert once.count() == 4 and joins.crop_to(once, stats.valid_bbox(once)).count() == 4


def test_blocks_means(spark):
    px = raster(spark, np.arange(35).reshape(5, 7).tolist())
    assert stats.block_mean(px, 4, 6, 2).agg(F.sum(F.col("mean") * 4)).first()[0] == pytest.approx(np.arange(35).reshape(5, 7)[:4, :6].sum())
    got = {(r.target_row, r.c): r.n for r in stats.proportional_blocks(px, 5, 3).collect()}
    want = {}
    for i in range(3):
        for r in range(int(i * 5 / 3), int((i + 1) * 5 / 3)):
            for c in range(7):
                want[i, c] = want.get((i, c), 0) + 1
    assert got == want


@pytest.mark.parametrize("n, sigma", [(12, 1.0), (6, 3.0)])
def test_low_pass(spark, n, sigma):
    a = np.random.default_rng(2).normal(0, 1, (n, n + 1))
    kernel = focal.gaussian_kernel(sigma)
    radius = len(kernel) // 2
    w = np.array([x for _, x in kernel])
    smooth = lambda x: np.array([np.convolve(np.pad(row, radius, mode="symmetric"), w, "valid") for row in x])
    want = smooth(smooth(a.T).T)
    assert np.allclose(grid(focal.low_pass(raster(spark, a.tolist()), n, n + 1, sigma), a.shape), want)
    flat = raster(spark, [[3.0, None, 3.0]] * 4)
    got = grid(focal.low_pass(flat, 4, 3, 1.0), (4, 3))
    assert np.allclose(got[:, [0, 2]], 3) and np.isnan(got[:, 1]).all()


def test_resize(spark):
    a = np.random.default_rng(3).normal(0, 1, (4, 5))
    px = raster(spark, a.tolist())
    assert np.allclose(grid(focal.resize(px, (4, 5), (4, 5)), (4, 5)), a)
    assert np.allclose(grid(focal.resize(px, (4, 5), (4, 5), "bicubic"), (4, 5)), a)
    twice = grid(focal.resize(px, (4, 5), (7, 9)), (7, 9))
    assert np.allclose(twice[::2, ::2], a) and np.allclose(twice[0, 1], (a[0, 0] + a[0, 1]) / 2)
    assert np.allclose(grid(focal.resize(px, (4, 5), (7, 9), "bicubic"), (7, 9))[::2, ::2], a)
    with pytest.raises(ValueError):
        focal.resize(px, (4, 5), (2, 2), "nearest")


def test_taper(spark):
    px = raster(spark, [[5.0] * 3] * 8)
    parts = focal.halo_blocks(px, "r", 8, 4, 2)
    out = focal.taper_blend(parts, "r", 2).collect()
    assert len(out) == 24 and all(r.v == pytest.approx(5) for r in out) and {r.r: r.n_blocks for r in out}[3] == 2


def test_hillshade(spark):
    flat = focal.hillshade(raster(spark, [[1.0] * 4] * 4)).collect()
    assert len(flat) == 4 and all(r.shade == pytest.approx(math.sin(math.pi / 4)) for r in flat)


def test_neighbours(spark):
    r = random.Random(1)
    pts = [(i, r.uniform(-50, 50), r.uniform(-50, 50), 0.0) for i in range(300)]
    cen = [(b, r.uniform(-50, 50), r.uniform(-50, 50)) for b in range(5)]
    pairs = joins.neighbours(spark.createDataFrame(cen, "block bigint, cx double, cy double"), spark.createDataFrame(pts, "id bigint, x double, y double, z double"), 13.0)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()
    want = {(b, i) for b, cx, cy in cen for i, x, y, _ in pts if math.hypot(x - cx, y - cy) <= 13}
    assert {(x.block, x.id) for x in pairs.collect()} == want
    assert joins.nearest(pairs, 3).groupBy("block").count().agg(F.max("count")).first()[0] == 3


def test_boxes(spark):
    r = random.Random(2)
    b = [(i, x := r.uniform(-90, 90), y := r.uniform(-90, 90), x + r.uniform(1, 60), y + r.uniform(1, 60)) for i in range(40)]
    got = {(x.id_a, x.id_b) for x in joins.bbox_overlap(spark.createDataFrame(b, "id bigint, left double, bottom double, right double, top double"), 25.0).collect()}
    assert got == {(p[0], q[0]) for p in b for q in b if p[0] < q[0] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}


def test_variogram_models():
    for m in ("spherical", "exponential", "gaussian", "linear"):
        v = geostat.Variogram(m, 2.0, 10.0, 0.5)
        h = np.linspace(0, 30, 50)
        assert v(h)[0] == 0 and (np.diff(v(h)) >= -1e-12).all() and 2.4 < v(h)[-1] <= 2.5
    with pytest.raises(ValueError):
        geostat.Variogram("cubic", 1, 1, 0)(np.ones(1))


def test_variogram_within(spark):
    rng = np.random.default_rng(5)
    x, y, z = np.r_[rng.uniform(-20, 20, 150), 3.0, 3.0], np.r_[rng.uniform(-20, 20, 150), 8.0, 8.0], rng.normal(size=152)
    pts = spark.createDataFrame(list(zip(range(152), x.tolist(), y.tolist(), z.tolist())), "id bigint, x double, y double, z double")
    got = {r["lag_bin"]: (r["n_pairs"], r["semivariance"]) for r in geostat.variogram_within(pts, 10, 5.0).collect()}
    i, j = np.triu_indices(152, 1)
    h, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    near = (h > 0) & (h < 5)
    bins = np.floor(h[near] / 0.5).astype(int)
    assert got.keys() == set(bins.tolist())
    for k, (n, mean) in got.items():
        assert n == (bins == k).sum() and mean == pytest.approx(g[near][bins == k].mean())
    # the same table by the join of a bounded sample
    assert got.keys() == {r["lag_bin"] for r in geostat.variogram_bins(pts, 10, 5.0).collect()}


def test_kriging():
    r = np.random.default_rng(4)
    x, y = r.uniform(0, 20, 30), r.uniform(0, 20, 30)
    model = geostat.Variogram("spherical", 1.0, 15.0, 0.0)
    z = x + 2 * y
    value, variance = geostat.solve_block(x, y, z, x, y, model)
    assert np.allclose(value, z, atol=1e-6) and np.abs(variance).max() < 1e-6
    value, variance = geostat.solve_block(x, y, np.full(30, 7.0), x, y, model)
    assert (value == 7).all() and (variance == 0).all()
    assert np.isnan(geostat.solve_block(x[:3], y[:3], z[:3], x, y, model)[0]).all()


def test_krige_scene(spark):
    pts = spark.range(100).select("id", (F.col("id") % 10 * 2).cast("double").alias("x"), (F.floor(F.col("id") / 10) * 2).cast("double").alias("y")).withColumn("z", F.col("x") + F.col("y"))
    model = geostat.fit_variogram(pts)
    assert model.psill > 0
    out = grid(geostat.krige_scene(pts, model, 20, 20, size=10, halo=3), (20, 20))
    rows, cols = np.meshgrid(np.arange(18), np.arange(18), indexing="ij")
    assert np.nanmean(np.abs(out[:18, :18] - (rows + cols))) < 2.0


def test_krige_scene_of_many_blocks(spark):
    height, width, size, halo, radius = 25, 90, 10, 3, 6.0
    y, x = (a.ravel().astype(float) for a in np.mgrid[0:26:2, 0:92:2])
    z = 3 * np.sin(x / 7) + np.cos(y / 5)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(x, y, z, strict=True))], "id bigint, x double, y double, z double")
    model = geostat.Variogram("spherical", 5.0, 20.0, 0.0)
    total, weight = np.zeros((height, width)), np.zeros((height, width))
    for i in range(-(-height // size)):
        for j in range(-(-width // size)):
            (r0, r1), (c0, c1) = ((max(0, k * size - halo), min(n, (k + 1) * size + halo)) for k, n in ((i, height), (j, width)))
            gy, gx = np.mgrid[r0:r1, c0:c1].astype(float)
            d = np.hypot(x - gx.mean(), y - gy.mean())
            near = np.lexsort((np.arange(len(x)), d))[:36]
            near = near[d[near] <= radius + math.hypot(r1 - r0 - 1, c1 - c0 - 1) / 2]
            v, _ = geostat.solve_block(x[near], y[near], z[near], gx.ravel(), gy.ravel(), model)
            w = np.minimum(1, (np.minimum.reduce([gy - r0, r1 - 1 - gy, gx - c0, c1 - 1 - gx]) + 1) / (halo + 1))
            total[r0:r1, c0:c1] += w * v.reshape(gx.shape)
            weight[r0:r1, c0:c1] += w
    rows, cols = np.mgrid[0:height, 0:width]
    for given in (radius, None):
        out = geostat.krige_scene(pts, model, height, width, size=size, halo=halo, radius=given)
        v = grid(out, (height, width))
        assert not np.isnan(v).any() and np.abs(v - (3 * np.sin(cols / 7) + np.cos(rows / 5))).mean() < 0.2
        if given:
            assert np.allclose(v, total / weight, atol=1e-6) and {x.n_blocks for x in out.collect()} == {1, 2, 4}


def test_t_pvalue():
    # two-sided values of the t distribution, from its tables
    for t, df, p in ((2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0)):
        assert float(geostat.t_pvalue(np.array([t]), np.array([df]))[0]) == pytest.approx(p, abs=2e-4)


def test_template(spark):
    r = np.random.default_rng(5)
    image = r.normal(0, 50, (40, 30))
    t = image[12:18, 9:14]
    best = vision.best_match(vision.match_scores(raster(spark, t.tolist()), raster(spark, image.tolist()), 40, 30, 6, 5)).first()
    assert (best.dr, best.dc) == (12, 9) and best.score == pytest.approx(1) and best.confident
    found = max(vision.best_offsets(raster(spark, t.tolist()), raster(spark, image.tolist()), 40, 30, 6, 5, 16, 0.1).collect(), key=lambda x: x.score)
    assert (found.dr, found.dc) == (12, 9) and found.score == pytest.approx(1)


def test_transverse_mercator(spark):
    lon, lat = spark.range(1).select(*[x.alias(n) for x, n in zip(warp.SYSTEMS["EPSG:32629"].inverse(F.lit(500000.0), F.lit(0.0)), ("a", "b"), strict=True)]).first()
    assert lon == pytest.approx(-9) and lat == pytest.approx(0, abs=1e-12)
    e, n = spark.range(1).select(*[x.alias(k) for x, k in zip(warp.SYSTEMS["EPSG:2157"].forward(F.lit(-8.0), F.lit(53.5)), ("a", "b"), strict=True)]).first()
    assert e == pytest.approx(600000) and n == pytest.approx(750000, abs=1e-6)
    # half of one per cent of scale apart on the central meridian, as the arc of one degree tells
    n1 = spark.range(1).select(warp.SYSTEMS["EPSG:2157"].forward(F.lit(-8.0), F.lit(54.5))[1].alias("n")).first().n
    assert (n1 - 750000) / 0.99982 == pytest.approx(111300, abs=60)


def test_reproject(spark):
    px = raster(spark, [[float(r + c) for c in range(12)] for r in range(12)])
    t = (10.0, 0, 540000.0, 0, -10.0, 600000.0)
    same = grid(warp.reproject(px, "EPSG:2157", t, "EPSG:2157", (t, 12, 12)), (12, 12))
    assert np.allclose(same, np.add.outer(np.arange(12), np.arange(12)))
    box = warp.bounds_in(spark.createDataFrame([(1, 540000.0, 599880.0, 540120.0, 600000.0)], "id int, left double, bottom double, right double, top double"), "EPSG:2157", "EPSG:32629").first()
    target = warp.target_grid(box.left, box.bottom, box.right, box.top, 12, 12)
    out = grid(warp.reproject(px, "EPSG:2157", t, "EPSG:32629", target, "cubic"), target[:0:-1])
    assert np.isfinite(out).sum() > 100 and 9 < np.nanmean(out) < 13


def test_validate(spark):
    pair = spark.createDataFrame([(5.0, 3.0)] * 90 + [(2.0, 3.0)] * 6 + [(None, 1.0)] * 4, "dsm double, dtm double")
    rows = {r.check: (r.severity, r.metric) for r in validate.findings(validate.metrics(pair)).collect()}
    assert rows["height_logic"] == ("issue", 6.25) and rows["completeness"] == ("passed", 96.0) and rows["dsm_nodata"][0] == "passed"
    assert validate.passes(validate.findings(validate.metrics(pair))).first().valid is False
    meta = "width int, height int, crs string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    a, b = (spark.createDataFrame([(w, 10, "EPSG:2157", (0.5, 0.0, x, 0.0, -0.5, 0.0))], meta) for w, x in ((10, 0.0), (12, 3.0)))
    got = {r.check: r.severity for r in validate.meta_findings(a, b).collect()}
    assert got == {"crs": "passed", "shape": "warning", "origin": "issue", "pixel_size": "passed", "square": "passed", "resolution": "passed"}


def test_sinks(spark, tmp_path):
    perf = spark.createDataFrame([("a", 2, 3, 1.5), ("b", 1, 3, 2.5)], "method string, tiles_with_data bigint, total_tiles bigint, depth_mean double")
    files.write_tiles(perf, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    doc = files.summary_json(spark.createDataFrame([(7,)], "total int"), perf).first().value
    assert '"total":7' in doc and '"a":{' in doc
    assert files.report(perf).first().value == "a: 2 of 3 tiles, mean depth 1.500 m"


def test_numbered(spark):
    rows = stats.every_nth(spark.createDataFrame([(x * x,) for x in range(57)], "k bigint"), "k").collect()
    assert sorted(r.k for r in rows) == sorted((i - 1) ** 2 for i in range(1, 58) if i % 10 == 1 or i <= 3)
    assert stats.every_nth(spark.createDataFrame([], "k bigint"), "k").count() == 0


def test_sample(spark):
    df = spark.range(100)
    assert {r.id for r in geostat.sample(df, 10).collect()} == {r.id for r in geostat.sample(df.repartition(7), 10).collect()}
