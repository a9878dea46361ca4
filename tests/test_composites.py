"""Workflows over rasters, GeoTIFF and report sinks, on hand-made rasters against numpy."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import algebra as A
from thalweg.functions import names
from thalweg.operators import composites as C
from thalweg.operators import focal, geostat, joins, stats, validate, warp
from thalweg.schema import TILE_DEPTH
from thalweg.sources import blocks, files, geotiff

from .test_raster import grid, raster


def made(spark, a, **place):
    a = np.asarray(a, float)
    return C.Raster(raster(spark, [[None if np.isnan(v) else v for v in row] for row in a.tolist()]), *a.shape, **place)


def tiled(spark, tile, a, extra=""):
    rows = [(tile, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, "tile bigint, r bigint, c bigint, v double")


def test_read_window(spark):
    a = np.arange(80.0).reshape(8, 10)
    whole = made(spark, a, transform=(2.0, 0.0, 100.0, 0.0, -2.0, 50.0))
    part = C.read_window(whole, (104.0, 38.0, 112.0, 46.0))
    assert (part.height, part.width, part.bounds) == (4, 4, (104.0, 38.0, 112.0, 46.0))
    assert np.array_equal(grid(part.px, (4, 4)), a[2:6, 2:6])
    fine = C.read_window(whole, (104.0, 38.0, 112.0, 46.0), (7, 7))
    assert np.allclose(grid(fine.px, (7, 7)), np.add.outer(np.arange(7) * 5, np.arange(7) * 0.5) + 22) and fine.bounds == part.bounds
    beyond = C.read_window(whole, (116.0, 46.0, 124.0, 54.0))
    assert beyond.px.count() == 4 and C.on_grid(beyond.px, 4, 4).count() == 16


def test_tile_depths_and_outcomes(spark):
    """Every status; the flagship join against a loop over tiles."""
    rng = np.random.default_rng(2)
    masks, dsm, beds, want = [], [], [], {}
    for t in range(7):
        m, s = rng.integers(0, 256, (6, 6)), rng.uniform(10, 14, (6, 6))
        models = {"webodm": s - rng.uniform(-1, 6, (6, 6)), "fusion": s - rng.uniform(-1, 2, (6, 6))}
        s[0, 0] = np.nan
        if t == 2:
            m[:] = 127
        if t == 3:
            s[:] = np.nan
        if t == 4:
            models = {k: v + 40 for k, v in models.items()}
        if t != 1:
            masks.append(tiled(spark, t, m))
        dsm.append(tiled(spark, t, s))
        beds += [tiled(spark, t, v).withColumn("method", F.lit(k)) for k, v in models.items() if t != 5]
        for k, v in models.items():
            d = (s - v)[m > 127]
            ok = d[(d > 0) & (d < 5)]
            want[t, k] = (int((m > 127).sum()), len(ok), ok.mean() if len(ok) else None, np.median(ok) if len(ok) else None, ok.std() if len(ok) else None)
    union = lambda x: __import__("functools").reduce(lambda a, b: a.unionByName(b), x)
    out = C.tile_depths(spark.range(8).withColumnRenamed("id", "tile"), union(masks), union(dsm), union(beds), ("webodm", "fusion"))
    rows = {(r.tile, r.method): r for r in out.collect()}
    status = {t: rows[t, "webodm"].status for t in range(8)}
    assert status == {0: "ok", 1: "mask_not_found", 2: "no_water", 3: "no_dsm", 4: "no_valid_depths", 5: "no_valid_dtms", 6: "ok", 7: "mask_not_found"}
    assert len(rows) == 16 and all(rows[t, m].status == status[t] for t, m in rows)
    for t in (0, 6):
        for m in ("webodm", "fusion"):
            n, ok, mean, median, std = want[t, m]
            r = rows[t, m]
            assert (r.water_pixels, r.valid_pixels) == (n, ok) and r.coverage_pct == pytest.approx(100 * ok / n, abs=1e-6)
            assert (r.depth_mean, r.depth_median, r.depth_std) == pytest.approx((mean, median, std), abs=2e-6)
    assert {r.status: r.tiles for r in C.outcomes(out).collect()} == {"ok": 2, "mask_not_found": 2, "no_water": 1, "no_dsm": 1, "no_valid_depths": 1, "no_valid_dtms": 1}
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_georeference(spark):
    r = spark.createDataFrame([(156,)], "tile bigint").select("tile", *C.georeference(F.col("tile"), 63600, (0.5, 0.0, 10.0, 0.0, -0.5, 99.0))).first()
    assert (r.pixel_row, r.pixel_col, r.left, r.top, r.right, r.bottom) == (768, 56832, 28426.0, -285.0, 28938.0, -797.0)


def test_single_tile(spark):
    """A tile at a position that the search finds, its depths and its river's width."""
    rng = np.random.default_rng(3)
    image = rng.uniform(0, 255, (40, 50))
    where = C.tile_at(made(spark, image), raster(spark, image[10:22, 15:27].tolist()), (12, 12), (5, 5, 35, 45)).first()
    assert (where.dr, where.dc, where.confident) == (10, 15, True)
    dsm, dtm = np.full((40, 50), 12.0), np.full((40, 50), 9.5)
    mask = np.zeros((12, 12))
    mask[:, 3:8] = 255
    depths, width = C.single_tile(raster(spark, mask.tolist()), made(spark, dsm), made(spark, dtm), (where.dr, where.dc), made(spark, image), 12)
    d, w = depths.first(), width.first()
    assert (d.status, d.water_pixels, d.valid_pixels, d.depth_mean) == ("ok", 60, 60, 2.5) and (w.n_rows, w.mean_width) == (12, 5.0)


def test_compare_dtm_sources(spark):
    coarse = made(spark, np.full((3, 3), -48.0))
    mask = np.zeros((5, 5))
    mask[1:4] = 255
    r = C.compare_dtm_sources(raster(spark, mask.tolist()), raster(spark, np.full((5, 5), 12.0).tolist()), raster(spark, np.full((5, 5), 5.0).tolist()), coarse, (5, 5)).first()
    assert (r.n, r.dtm_diff_mean, r.fine_valid, r.fine_depth_mean, r.coarse_valid, r.coarse_depth_mean) == (25, 5.0, 15, 7.0, 15, 2.0)


def smoothed(a, sigma):
    """Gaussian of a numpy array, mirrored edges, cut at four sigma."""
    kernel = geostat.np.array([w for _, w in focal.gaussian_kernel(sigma)])
    radius = len(kernel) // 2
    for axis in (0, 1):
        padded = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda x: np.convolve(x, kernel, "valid"), axis, padded)
    return a


def test_fusion(spark):
    rng = np.random.default_rng(4)
    dsm, dtm = rng.uniform(10, 14, (9, 12)), rng.uniform(9, 12, (9, 12))
    dsm[2, 3] = dtm[5, 5] = np.nan
    low = smoothed(np.where(np.isnan(dsm), np.nanmean(dsm), dsm), 1.0)
    h = np.clip(dsm - dtm, 0, 50)
    want = dtm + np.exp(-h / 2) * (dsm - low)
    out = C.run_fusion(raster(spark, [[None if np.isnan(v) else v for v in x] for x in dsm.tolist()]), raster(spark, [[None if np.isnan(v) else v for v in x] for x in dtm.tolist()]), 9, 12, 1.0)
    got = grid(out.select("r", "c", F.col("fused").alias("v")), (9, 12))
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got).sum() == 2


def test_spline_weights():
    """The short convolution solves the spline's band system."""
    v = np.random.default_rng(5).uniform(0, 9, 50)
    w = focal.spline_weights(v)
    full = np.r_[w[1], w, w[-2]]
    assert np.allclose((full[:-2] + 4 * full[1:-1] + full[2:]) / 6, v)
    assert np.allclose(focal.spline_row(v, 50), v) and focal.spline_row(np.array([2.0, 4.0]), 3).tolist() == pytest.approx([2, 3, 4])
    assert len(focal.spline_row(np.zeros(40_000), 40_000)) == 40_000  # no system of that size is solved


def test_fill_lines(spark):
    a = [[1.0, None, 3.0], [None, None, None], [5.0, 6.0, 7.0]]
    got = grid(focal.fill_lines(raster(spark, a)), (3, 3))
    assert got[0].tolist() == [1, 2, 3] and got[1, 0] == 3 and got[1, 2] == 5 and np.isnan(got[1, 1])
    plane = np.add.outer(np.arange(6.0), 2 * np.arange(7.0))
    holes = plane.copy()
    holes[2, 2:4] = holes[4, 5] = np.nan
    assert np.allclose(grid(focal.fill_lines(made(spark, holes).px), (6, 7)), plane)
    spline = grid(focal.resize(made(spark, holes).px, (6, 7), (11, 13), "spline"), (11, 13))
    assert np.nanmax(np.abs(spline - np.add.outer(np.arange(11) / 2, np.arange(13)))) < 0.5
    with pytest.raises(ValueError):
        focal.resize(raster(spark, a), (3, 3), (5, 5), "nearest")


def test_bicubic_matched(spark):
    coarse = made(spark, np.add.outer(10 * np.arange(6.0), np.arange(8.0)), transform=(5.0, 0.0, 0.0, 0.0, -5.0, 30.0))
    fused = np.full((12, 16), np.nan)
    fused[4:12, 4:12] = 1.0
    fusion = made(spark, fused, transform=(1.25, 0.0, 5.0, 0.0, -1.25, 25.0))
    part = C.valid_part(fusion)
    assert part.bounds == (10.0, 10.0, 20.0, 20.0) and (part.height, part.width) == (8, 8)
    out = grid(C.bicubic_matched(fusion, coarse).px, (12, 16))
    assert out.shape == (12, 16) and out[0, 0] == pytest.approx(58 + 22) and out[-1, -1] == pytest.approx(58 + 33)


def test_kriging_workflows(spark):
    plane = np.add.outer(np.arange(24.0), 0.5 * np.arange(30.0))
    fusion = made(spark, plane)
    out, errors = C.run_fusion_based_kriging(fusion, 3, "linear", size=12, halo=3)
    v, variance = grid(out, (24, 30)), grid(out.select("r", "c", F.col("variance").alias("v")), (24, 30))
    e = errors.first()
    assert e.n == 24 * 30 and e.bias == pytest.approx(-1.5, abs=0.1) and e.std < 0.3 and (variance >= 0).all()
    assert np.allclose(v[1::3, 1::3], plane[::3, ::3], atol=1e-3)  # each value at its coarse pixel's centre
    coarse = made(spark, plane[::3, ::3], transform=(3.0, 0.0, -1.0, 0.0, -3.0, 1.0))
    full = C.run_kriging(coarse, fusion, "linear", offset=0.0, size=24, halo=4, radius=12.0)
    assert full.count() == 24 * 30
    hole = plane.copy()
    hole[:, 20:] = np.nan
    masked, part = C.run_masked_kriging(coarse, made(spark, hole), "linear", offset=0.0, margin=2, size=12, halo=3, radius=8.0)
    assert (part.height, part.width) == (24, 22) and masked.count() == 24 * 22


def test_krige_scene_keeps_missing_cells(spark):
    pts = spark.createDataFrame([(i, float(i % 4), float(i // 4), float(i)) for i in range(16)], "id bigint, x double, y double, z double")
    out = geostat.krige_scene(pts, geostat.Variogram("spherical", 1.0, 8.0, 0.0), 10, 40, size=10, halo=2, radius=2.0).collect()
    assert len(out) == 400 and all(r.v is not None and r.variance is not None for r in out if r.c < 6) and all(r.v is None and r.n_blocks == 0 for r in out if r.c > 30)


def test_validate_all_and_align(spark):
    dtm = np.full((10, 10), 5.0)
    dsm = np.full((12, 10), 6.0)
    dsm[0, 0] = 90.0
    meta = {"transform": (0.1, 0.0, 0.0, 0.0, -0.1, 0.0)}
    a, b, found, verdict = C.align_and_validate(made(spark, dsm, **meta), made(spark, dtm, **meta))
    rows = {r.check: r.severity for r in found.collect()}
    assert (a.height, b.height, a.px.count()) == (10, 10, 100) and verdict.first().valid and rows["tall"] == "warning" and rows["outliers"] == "passed" and rows["dsm_loads"] == "passed"
    empty = made(spark, np.full((10, 10), np.nan), **meta)
    rows = {r.check: r.severity for r in C.validate_all(made(spark, dtm, **meta), empty).collect()}
    assert rows["dtm_loads"] == "issue" and rows["completeness"] == "issue"
    assert not validate.passes(C.validate_all(made(spark, dtm, **meta), empty)).first().valid


def test_comparisons(spark):
    rng = np.random.default_rng(6)
    fine = rng.uniform(70, 72, (24, 24))
    coarse = np.array([[fine[i * 4 : i * 4 + 4, j * 4 : j * 4 + 4].mean() for j in range(6)] for i in range(6)])
    c = C.coarse_comparison(made(spark, fine), made(spark, coarse - 0.1, transform=(4.0, 0, 0, 0, -4.0, 0)), 4.0).first()
    assert c.blocks_compared == 36 and c.mean_diff == pytest.approx(0.1, abs=1e-5) and c.agreement == "excellent" and not c.is_datum_offset
    a = made(spark, fine, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 24.0))
    b = made(spark, np.repeat(np.repeat(coarse, 2, 0), 2, 1) - 57, transform=(2.0, 0.0, 8.0, 0.0, -2.0, 24.0))
    shifted = C.overlap_comparison(a, b, 4.0).first()
    part = np.array([[fine[i * 4 : i * 4 + 4, 8 + j * 4 : 12 + j * 4].mean() for j in range(4)] for i in range(6)]) - (coarse[:, :4] - 57)
    assert shifted.blocks_compared == 24 and shifted.mean_diff == pytest.approx(part.mean(), abs=1e-5) and shifted.std_diff == pytest.approx(part.std(), abs=1e-5) and shifted.is_datum_offset and shifted.agreement == "datum_offset"
    with pytest.raises(ValueError, match="overlap"):
        C.overlap_comparison(a, made(spark, fine, transform=(1.0, 0.0, 900.0, 0.0, -1.0, 24.0)))
    with pytest.raises(ValueError, match="differ"):
        C.overlap_comparison(a, made(spark, fine, crs="EPSG:2157"))


def test_clean(spark):
    dsm, dtm = [[5.0, 2.0, None], [90.0, 4.0, 7.0]], [[3.0, 3.0, 1.0], [10.0, 4.05, None]]
    out, counts = C.clean(raster(spark, dsm), raster(spark, dtm))
    got = grid(out, (2, 3))
    assert got[0, :2].tolist() == [5, 3] and np.isnan(got[0, 2]) and np.isnan(got[1, 0]) and got[1, 1] == 4.05 and got[1, 2] == 7
    c = counts.first()
    assert (c.violations_before, c.violations_after, c.tall_before, c.tall_after, c.n) == (1, 0, 1, 0, 4)


def test_gather_and_masks(spark):
    px = raster(spark, [[1.0, 2.0], [3.0, 4.0]])
    mask = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (5, 5)], "r bigint, c bigint")
    assert sorted(r.v for r in joins.gather(px, mask).collect()) == [2, 3]
    tiles = spark.createDataFrame([(3,), (4,)], "tile_num int")
    assert [r.tile_num for r in joins.tiles_with_masks(tiles, spark.createDataFrame([("a_patch_0003.png",), ("b_patch_0003.png",)], "file string")).collect()] == [3]


def test_debug_and_preflight(spark):
    here = made(spark, np.full((10, 10), 100.0), transform=(10.0, 0.0, 540000.0, 0.0, -10.0, 600000.0), crs="EPSG:2157")
    utm = C.to_utm(here)
    rows = {r.check: (r.severity, r.metric) for r in C.debug_comparison(here, utm).collect()}
    assert rows["crs"][0] == "issue" and rows["overlap"][0] == "passed" and rows["overlap"][1] == pytest.approx(100, abs=2) and rows["a_elevation"] == ("passed", 100.0)
    odd = made(spark, np.full((4, 4), np.nan), crs="EPSG:4326", transform=(1.0, 0.0, 9e6, 0.0, -1.0, 0.0))
    rows = {r.check: r.severity for r in C.debug_comparison(made(spark, np.full((4, 4), 900.0), crs="EPSG:4326"), odd).collect()}
    assert rows == {"crs": "passed", "a_projected": "issue", "b_projected": "issue", "overlap": "issue", "a_elevation": "issue", "a_nodata": "passed", "b_elevation": "issue", "b_nodata": "issue"}
    manifest = spark.createDataFrame([("a",), ("b",)], "path string")
    there = spark.createDataFrame([("a", 5)], "path string, length bigint")
    rows = {r.check: r.severity for r in C.preflight(manifest, there, {"x": here, "y": odd}, 4, 2).collect()}
    assert rows == {"file:a": "passed", "file:b": "issue", "crs": "issue", "resolution": "warning", "tiles": "issue", "coverage:x": "passed", "coverage:y": "issue"}


def test_coverage(spark):
    a = np.full((10, 10), np.nan)
    a[2:6, 3:8] = 1.0
    a[3, 4] = np.nan
    r = C.coverage(made(spark, a).px).first()
    assert (r.total, r.n_valid, r.r_min, r.r_max, r.c_min, r.c_max, r.coverage_pct, r.fill_pct, r.status, r.box_status) == (100, 19, 2, 5, 3, 7, 19.0, 95.0, "partial", "dense")
    assert C.coverage(made(spark, np.full((2, 2), np.nan)).px).first().status == "empty"
    pct = spark.createDataFrame([(5.0,), (50.0,), (99.0,), (None,)], "p double").select(*[A.coverage_tier(F.col("p"), t).alias(n) for n, t in (("a", A.READY_TIERS), ("b", A.OVERLAP_TIERS))]).collect()
    assert [tuple(x) for x in pct] == [("unusable", "very_low"), ("sparse", "moderate"), ("good", "full"), ("unusable", "very_low")]


def test_methods_and_analysis(spark):
    rng = np.random.default_rng(7)
    a = rng.uniform(0, 9, (5, 6))
    b = a + 1
    b[0, 0] = np.nan
    px = made(spark, a).px.withColumn("method", F.lit("fusion")).unionByName(made(spark, b).px.withColumn("method", F.lit("kriged")))
    each, pairs = C.compare_methods(px, 2, "fusion")
    p = pairs.first()
    assert {r.method: r.n for r in each.collect()} == {"fusion": 29, "kriged": 29} and (p.n, p.mean_diff, p.std_diff, p.correlation) == (29, 1.0, 0.0, 1.0)
    rows = [(t, m, k, 20, 100, 20.0, float(t) + shift + 0.1 * ((t * (k + 3)) % 5), 1.0, 1.0, 0.5, 2.0, 9.0, 1.0, 8.0, 1.0) for t in range(12) for m, k, shift in (("webodm", 0, 0.0), ("bluesky", 1, 2.0))]
    cols = "tile bigint, method string, rank int, valid_pixels bigint, water_pixels bigint, coverage_pct double, depth_mean double, depth_median double, depth_std double, depth_min double, depth_max double, surface_mean double, surface_std double, riverbed_mean double, riverbed_std double"
    perf, full = C.analysis(spark.createDataFrame(rows, cols))
    x = full.first()
    assert perf.count() == 2 and len(full.columns) == 12 and x.significance == "significant" and x.bias > 1.5 and x.correlation_p < 1e-6
    text = [r.value for r in files.report(perf, full).collect()]
    assert text[0] == "METHODS" and text[3] == "PAIRS" and text[4].startswith("webodm - bluesky: bias 2.008 m, RMSE 2.013 m") and text[4].endswith(", significant")


def test_scalar_helpers(spark):
    t = spark.range(1).select(A.zero_missing(F.lit(0.0)).alias("a"), A.zero_missing(F.lit(2.0)).alias("b"), A.significance(F.lit(0.01)).alias("c"), A.significance(F.lit(0.5)).alias("d"), A.stamp(F.lit("2026-02-03 04:05:06").cast("timestamp")).alias("e"), *[x.alias(n) for x, n in zip(A.band(F.lit(10.0), F.lit(2.0)), "fg", strict=True)], A.implausible_mean(F.lit(501.0)).alias("h"), names.stem(F.lit("a/b.c/d.e.tif")).alias("i"), names.renamed(F.lit("a/b.c/d.tif"), "_cut").alias("j"), names.stem(F.lit("plain")).alias("k")).first()
    assert (t.a, t.b, t.c, t.d, t.e, t.h, t.i, t.j, t.k) == (None, 2.0, "significant", "not significant", "2026-02-03 04:05:06", True, "d.e", "a/b.c/d_cut.tif", "plain") and (t.f, t.g) == pytest.approx((6.08, 13.92))
    assert warp.to_epsg("EPSG:2157") == 2157 and warp.to_epsg("WGS84") is None and warp.is_geographic("epsg:4326") and not warp.is_geographic(None)
    wide = spark.createDataFrame([(1, 2.0, 3, 4.0)], "tile int, webodm_depth_mean double, webodm_valid_pixels int, fusion_depth_mean double")
    assert names.found_methods(wide.columns) == ["webodm", "fusion"]
    rows = names.long_form(wide, ["tile"], C.METHODS, ("depth_mean", "valid_pixels")).collect()
    assert sorted((r.method, r.depth_mean, r.valid_pixels) for r in rows) == [("fusion", 4.0, None), ("webodm", 2.0, 3)]


def test_ascii_to_utm(spark, tmp_path):
    folder = tmp_path / "asc"
    folder.mkdir()
    head = "ncols 4\nnrows 3\nxllcorner {x}\nyllcorner 600000\ncellsize 5\nNODATA_value -9999\n"
    (folder / "a.asc").write_text(head.format(x=540000) + "1 2 3 4\n5 6 7 8\n9 10 11 -9999\n")
    (folder / "b.asc").write_text(head.format(x=540015) + "40 41 42 43\n50 51 52 53\n60 61 62 63\n")
    (tmp_path / "a.prj").write_text('PROJCS["IRENET95 / Irish Transverse Mercator",AUTHORITY["EPSG","2157"]]')
    whole = C.ascii_mosaic(spark, str(folder))
    a = grid(whole.px, (whole.height, whole.width))
    assert (whole.height, whole.width, whole.bounds) == (3, 7, (540000.0, 600000.0, 540035.0, 600015.0))
    assert a[0].tolist() == [1, 2, 3, 4, 41, 42, 43] and a[2, 3] == 60  # the first file has nothing there
    utm = C.ascii_to_utm(spark, str(folder), str(tmp_path / "a.prj"), 58.0)
    v = grid(utm.px, (utm.height, utm.width))
    assert utm.crs == "EPSG:32629" and np.nanmin(v) > 58 and np.nanmax(v) < 58 + 64 and np.isfinite(v).sum() > 12
    back = C.warp_to(utm, whole, "bilinear", -58.0)
    assert back.crs == "EPSG:2157" and np.nanmedian(np.abs(grid(back.px, (3, 7)) - a)) < 3


@pytest.mark.parametrize("big, predictor, deflate", [(False, 1, True), (True, 3, True), (True, 1, False), (False, 3, True)])
def test_geotiff_bands_and_big(spark, tmp_path, big, predictor, deflate):
    a = np.random.default_rng(8).uniform(0, 255, (70, 9, 3)).round(3)
    a[3, 4, 1] = np.nan
    path = str(tmp_path / "x.tif")
    geotiff.write_strip_tiff(path, a, (0.5, 0.0, 100.0, 0.0, -0.5, 200.0), big=big, predictor=predictor, deflate=deflate, epsg=32629)
    with open(path, "rb") as f:
        assert struct.unpack("<H", f.read(4)[2:])[0] == (43 if big else 42)
    spark.dataSource.register(geotiff.GeoTiffSource)
    px = blocks.pixels(spark.read.format("geotiff").load(path))
    got = np.full(a.shape, np.nan)
    for r in px.collect():
        got[r.row, r.col, r.band - 1] = np.nan if r.value is None else r.value
    assert np.allclose(got, a, atol=1e-4, equal_nan=True)
    wide = blocks.bands(px).filter("row = 3 and col = 4").first()
    assert wide.b2 is None and wide.b1 == pytest.approx(a[3, 4, 0], abs=1e-4)
    m = geotiff.raster_meta(spark, [path]).first()
    assert (m.raster_id, m.width, m.height, m.crs, m.nodata, m.dtype) == ("x.tif", 9, 70, "EPSG:32629", -9999.0, "float32") and m.transform.a == 0.5 and m.bounds.bottom == 165.0


def test_export_blocks(spark, tmp_path):
    px = spark.range(12 * 10).select(F.lit("dem").alias("raster_id"), F.lit(1).alias("band"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("value"))
    changed = blocks.overlaid(px, spark.createDataFrame([("dem", 1, 0, 0, 500.0), ("dem", 1, 0, 1, None)], "raster_id string, band int, row int, col int, value double"))
    out = geotiff.export_blocks(blocks.to_blocks(changed, 8), str(tmp_path), (2.0, 0.0, 10.0, 0.0, -2.0, 50.0), epsg=2157, predictor=3).collect()
    assert len(out) == 4 and all(r.length == (tmp_path / r.path.rsplit("/", 1)[1]).stat().st_size for r in out) and len(list(tmp_path.iterdir())) == 4
    spark.dataSource.register(geotiff.GeoTiffSource)
    got = {}
    for r in out:
        m = geotiff.described(r.path)
        assert m["crs"] == "EPSG:2157"
        for x in blocks.pixels(spark.read.format("geotiff").load(r.path)).collect():
            got[round((50 - m["transform"][5]) / 2) + x.row, round((m["transform"][2] - 10) / 2) + x.col] = x.value
    assert len(got) == 120 and got[0, 0] == 500 and got[0, 1] is None and got[0, 7] is None and got[11, 9] == 119


def test_report_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "method string, n int")
    assert files.json_array(a).first().value == '[{"method":"x","n":1},{"method":"y","n":2}]'
    lines = files.sections({"Statistics": a, "Pairs": a.filter("n = 2")})
    want = ["# Statistics", "method,n", "x,1", "y,2", "# Pairs", "method,n", "y,2"]
    assert [r.value for r in lines.collect()] == want
    files.write_text(lines, str(tmp_path / "two"))
    assert [r.value for r in spark.read.text(str(tmp_path / "two")).collect()] == want
    tiles = spark.createDataFrame([(7, 90.5, 80.25, "i7.jpg", "m7.png"), (3, 50.0, 40.0, "i3.jpg", "m3.png")], "tile_num int, dsm_pct double, dtm_pct double, image_file string, mask_file string")
    files.write_text(files.work_list_text(tiles), str(tmp_path / "list"))
    back = files.work_list(spark, str(tmp_path / "list") + "/*.txt").collect()
    assert sorted((r.tile_num, r.image_file) for r in back) == [(3, "i3.jpg"), (7, "i7.jpg")] and files.work_list_size(spark, str(tmp_path / "list")) == 2


def test_tile_rows(spark, tmp_path):
    depths = stats.tile_depth(spark.createDataFrame([(1, "webodm", 0, 9.0, 7.0), (1, "webodm", 0, 9.0, 6.0)], "tile bigint, method string, rank int, surface double, riverbed double")).withColumn("status", F.lit("ok"))
    names_ = [x.split()[0] for x in TILE_DEPTH.split(", ")]
    files.write_tiles(depths.select(*names_).withColumn("m", F.col("method")).drop("m"), str(tmp_path / "t"))
    back = files.tile_rows(spark, str(tmp_path / "t"), ", ".join(x for x in TILE_DEPTH.split(", ") if not x.startswith("method")))
    r = back.first()
    assert (r.tile, r.valid_pixels, r.depth_mean, r.status, r.method) == (1, 2, 2.5, "ok", "webodm") and dict(back.dtypes)["depth_mean"] == "double"
    assert math.isclose(r.coverage_pct, 100.0)
