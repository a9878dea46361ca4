"""Adaptive neighbours, zone maps, ASCII grids in ranges, systems by definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import blockwise, joins, spatial, warp, zones
from thalweg.operators.composites import ascii_mosaic
from thalweg.sources import files


def clusters(seed=3):
    r = random.Random(seed)
    pts = [(r.gauss(0, 0.001), r.gauss(0, 0.001)) for _ in range(900)] + [(r.gauss(50, 5), r.gauss(20, 5)) for _ in range(500)] + [(r.uniform(-1000, 1000), r.uniform(-1000, 1000)) for _ in range(60)]
    pts += [(7.0, 7.0)] * 120  # one place
    return [(i, x, y, 0.0) for i, (x, y) in enumerate(pts)]


@pytest.mark.parametrize("k, bound", [(5, 16), (36, 64), (2000, 64)])
def test_knn_over_clusters(spark, k, bound):
    pts, r = clusters(), random.Random(9)
    cen = [(b, *random.Random(b).choice(pts)[1:3]) for b in range(6)] + [(10 + b, r.uniform(-1500, 1500), r.uniform(-1500, 1500)) for b in range(6)] + [(99, 7.0, 7.0)]
    got = {}
    points = spark.createDataFrame([*pts, (10**6, None, 1.0, 0.0)], "id bigint, x double, y double, z double").repartition(4)
    for x in spatial.knn(spark.createDataFrame(cen, "block bigint, cx double, cy double"), points, k, bound).collect():
        got.setdefault(x["block"], []).append((x["rank"], x["id"]))
    for b, cx, cy in cen:
        want = sorted(pts, key=lambda p: (math.sqrt((p[1] - cx) * (p[1] - cx) + (p[2] - cy) * (p[2] - cy)), p[0]))[:k]
        assert [i for _, i in sorted(got[b])] == [p[0] for p in want]


def test_quadtree_cells_are_bounded(spark):
    points = spark.createDataFrame(clusters(), "id bigint, x double, y double, z double")
    tree = spatial.quadtree(points, 16)
    sizes = tree.points.groupBy("level", "qx", "qy").agg(F.count("*").alias("n"), F.count_distinct("x").alias("places")).collect()
    assert sum(r["n"] for r in sizes) == len(clusters()) and max(r["n"] for r in sizes if r["places"] > 1) <= 16
    assert tree.nodes.filter("leaf").agg(F.sum("n")).first()[0] == len(clusters())
    empty = spatial.knn(spark.createDataFrame([(1, 0.0, 0.0)], "block bigint, cx double, cy double"), points.limit(0), 3)
    assert empty.collect() == []


def test_candidate_tiles(spark):
    tiles = lambda *n: spark.createDataFrame([(x,) for x in n], "tile bigint")
    got = {r["tile"] for r in joins.candidate_tiles(tiles(0, 13), tiles(59, 13, 1), 6, 10, 1).collect()}
    assert got == {0, 1, 9, 10, 11} | {2, 3, 4, 12, 13, 14, 22, 23, 24} | {59}


def stored(spark, x, transform, size):
    rows = [(r, c, None if v != v else float(v)) for r, row in enumerate(x.tolist()) for c, v in enumerate(row)]
    grid = blockwise.Grid(*x.shape, size)
    px = spark.createDataFrame(rows, "r bigint, c bigint, v double")
    return zones.Stored(blockwise.raster_blocks(blockwise.pack(px, grid), grid, "x"), *x.shape, transform, size)


def test_tiles_over_unlike_grids(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (70, 60)), rng.normal(0, 1, (31, 25))
    a[rng.random(a.shape) < 0.3] = np.nan
    a[:20, 30:] = np.nan
    b[10:20] = np.nan
    ta, tb = (1.0, 0.0, 100.0, 0.0, -1.0, 500.0), (2.5, 0.0, 97.0, 0.0, -2.5, 507.0)
    boxes = [(i * 10 + j, 95.0 + 9 * j, 505.0 - 9 * i - 13, 95.0 + 9 * j + 13, 505.0 - 9 * i) for i in range(9) for j in range(8)]

    def count(x, t, box):
        snap = lambda v: math.floor(v + 0.5)
        r0, c0 = snap((box[4] - t[5]) / t[4]), snap((box[1] - t[2]) / t[0])
        h, w = max(1, snap((box[2] - box[4]) / t[4])), max(1, snap((box[3] - box[1]) / t[0]))
        part = x[max(0, r0) : max(0, r0 + h), max(0, c0) : max(0, c0 + w)]
        return int(np.isfinite(part).sum()), h * w

    sa, sb = stored(spark, a, ta, 8), stored(spark, b, tb, 7)
    tiles = spark.createDataFrame(boxes, "tile bigint, left double, bottom double, right double, top double")
    for s, x, t in ((sa, a, ta), (sb, b, tb)):
        assert {r["tile"]: (r["n_valid"], r["pixels"]) for r in zones.coverage(tiles, s).collect()} == {q[0]: count(x, t, q) for q in boxes}
    got = {r["tile"]: (r["n_a"], r["n_b"]) for r in zones.usable_tiles(tiles, sa, sb, 5).collect()}
    assert got == {q[0]: (count(a, ta, q)[0], count(b, tb, q)[0]) for q in boxes if min(count(a, ta, q)[0], count(b, tb, q)[0]) >= 5}
    # blocks that are empty, whole or wholly inside aren't read
    met = zones._touched(tiles, sa)
    assert met.filter("overlap = h * w").count() > 40


def test_ascii_in_many_ranges(spark, tmp_path):
    """A grid split over tasks gives the same cells; lines may be broken anywhere."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(100, 30, (60, 41)), 3)
    x[rng.random(x.shape) < 0.1] = -9999
    values = x.ravel().tolist()
    head = "NCOLS 41\nNROWS 60\nxllcenter 500\nyllcenter 200\ncellsize 10\nNODATA_value -9999\n"
    (tmp_path / "rows.asc").write_text(head + "\n".join(" ".join(map(repr, row)) for row in x.tolist()) + "\n")
    (tmp_path / "broken.asc").write_text(head + "".join(f" {v!r}" + ("\r\n" if i % 17 == 5 else "") for i, v in enumerate(values)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name in ("rows.asc", "broken.asc"):
            assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 5
            got = {(r["r"], r["c"]): (r["x"], r["y"], r["v"]) for r in files.ascii_pixels(spark, str(tmp_path / name)).collect()}
            assert got == {(r, c): (500.0 + 10 * c, 200.0 + 10 * (59 - r), None if x[r, c] == -9999 else x[r, c]) for r in range(60) for c in range(41)}
            assert files.ascii_header(spark, str(tmp_path / name)).first()["left"] == 495.0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    mosaic = ascii_mosaic(spark, str(tmp_path / "rows.asc"))
    assert (mosaic.height, mosaic.width, mosaic.transform[2]) == (60, 41, 495.0)


def test_ascii_round_trip(spark, tmp_path):
    px = spark.createDataFrame([(r, c, None if (r + c) % 5 == 0 else r + c / 7) for r in range(23) for c in range(6)], "r bigint, c bigint, v double").repartition(5)
    files.write_ascii(px, str(tmp_path / "out"), (2.0, 0.0, 10.0, 0.0, -2.0, 90.0), 6, 23, 10)
    got = {(r["x"], r["y"]): r["v"] for r in files.ascii_pixels(spark, str(tmp_path / "out/*/*.txt")).collect()}
    assert got == {(10 + 2 * (c + 0.5), 90 - 2 * (r + 0.5)): (None if (r + c) % 5 == 0 else r + c / 7) for r in range(23) for c in range(6)}


def once(spark, source, target, *points):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, x double, y double")
    x, y = warp.transform(F.col("x"), F.col("y"), source, target)
    return [(r["a"], r["b"]) for r in df.select("i", x.alias("a"), y.alias("b")).orderBy("i").collect()]


# Published by the systems' makers: a worked example of the British grid, and a place in both Irish grids.
def test_known_places(spark):
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    assert once(spark, "EPSG:4277", "EPSG:27700", (lon, lat))[0] == pytest.approx((651409.903, 313177.270), abs=0.002)
    assert once(spark, "EPSG:29903", "EPSG:2157", (315904, 234671))[0] == pytest.approx((715830, 734697), abs=3)


ITM = 'PROJCS["IRENET95 / Irish Transverse Mercator",GEOGCS["IRENET95",DATUM["IRENET95",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",53.5],PARAMETER["central_meridian",-8],PARAMETER["scale_factor",0.99982],PARAMETER["false_easting",600000],PARAMETER["false_northing",750000],UNIT["metre",1]]'
FEET = ITM.replace('UNIT["metre",1]', 'UNIT["Foot",0.3048]').replace("false_easting\",600000", f'false_easting",{600000 / 0.3048!r}').replace("false_northing\",750000", f'false_northing",{750000 / 0.3048!r}')
WGS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
TM65 = 'PROJCS["TM65 / Irish Grid",GEOGCS["TM65",DATUM["TM65",SPHEROID["Airy Modified 1849",6377340.189,299.3249646],TOWGS84[482.5,-130.6,564.6,-1.042,-0.214,-0.631,8.15]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",53.5],PARAMETER["central_meridian",-8],PARAMETER["scale_factor",1.000035],PARAMETER["false_easting",200000],PARAMETER["false_northing",250000],UNIT["metre",1]]'


def test_systems_by_definition(spark):
    places = [(600000, 750000), (530000, 560000), (715830, 734697)]
    for name, same in ((ITM, "EPSG:2157"), (WGS, "EPSG:4326"), (TM65, "EPSG:29903")):
        there = once(spark, "EPSG:2157", same, *places)
        np.testing.assert_allclose(once(spark, "EPSG:2157", name, *places), there, rtol=1e-12)
        np.testing.assert_allclose(once(spark, name, "EPSG:2157", *there), places, atol=0.005)
    np.testing.assert_allclose(np.array(once(spark, "EPSG:2157", FEET, *places)) * 0.3048, places, atol=1e-6)
    for zone in (29, 30):
        there = once(spark, "EPSG:2157", f"EPSG:326{zone}", *places)
        np.testing.assert_allclose(once(spark, f"EPSG:326{zone}", "EPSG:2157", *there), places, atol=1e-4)
    assert warp.system("EPSG:32733").false_north == 1e7 and warp.system("EPSG:25830").central == -3
    assert warp.is_geographic(WGS) and not warp.is_geographic(ITM) and not warp.is_geographic("EPSG:99999") and not warp.is_geographic(None)
    for unknown, said in (("EPSG:99999", "99999"), ("LOCAL", "LOCAL"), (ITM.replace("Transverse_Mercator", "Krovak"), "Irish Transverse Mercator"), ('PROJCS["bare"]', "bare")):
        with pytest.raises(ValueError, match=said):
            warp.system(unknown)


def test_datum_shift_against_plain_steps(spark):
    """Seven parameters by geocentric coordinates, written out."""
    (a, f), shift = (6377563.396, 1 / 299.3249646), (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
    lon, lat = math.radians(-1.5), math.radians(52.0)
    e2 = f * (2 - f)
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    p = np.array([n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat)])
    rx, ry, rz = (math.radians(x / 3600) for x in shift[3:6])
    q = np.array(shift[:3]) + (1 + shift[6] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]) @ p
    a, e2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
    phi = math.atan2(q[2], math.hypot(q[0], q[1]) * (1 - e2))
    for _ in range(20):
        n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        phi = math.atan2(q[2] + e2 * n * math.sin(phi), math.hypot(q[0], q[1]))
    got = once(spark, "EPSG:4277", "EPSG:4326", (-1.5, 52.0))[0]
    assert got == pytest.approx((math.degrees(math.atan2(q[1], q[0])), math.degrees(phi)), abs=1e-10)


def test_prj_files(spark, tmp_path):
    for name, text, want in (("a", ITM, "EPSG:2157"), ("b", FEET.replace("ITM", "x").replace("IRENET95", "Own"), None), ("c", "nothing", "EPSG:2157")):
        (tmp_path / f"{name}.prj").write_text(text)
        crs = files.projection(spark, str(tmp_path / f"{name}.prj")).first()["crs"]
        assert crs == want if want else warp.system(crs).unit == 0.3048


def mapped_back(pixels, source, grid, reach, near):
    """reproject() within one system, pixel by pixel."""
    (a, _, c, _, e, f), width, height = grid
    sa, _, sc, _, se, sf = source
    out = {}
    for row in range(height):
        for col in range(width):
            r, q = (f + (row + 0.5) * e - sf) / se - 0.5, (c + (col + 0.5) * a - sc) / sa - 0.5
            w = s = 0.0
            for i in range(math.floor(r) + reach[0], math.floor(r) + reach[1] + 1):
                for j in range(math.floor(q) + reach[0], math.floor(q) + reach[1] + 1):
                    for v in pixels.get((i, j), ()):
                        w, s = w + near(abs(r - i)) * near(abs(q - j)), s + near(abs(r - i)) * near(abs(q - j)) * v
            if abs(w) > 1e-9:
                out[row, col] = s / w
    return out


FINER, COARSER, CLOSE = ((0.75, 0.0, 96.3, 0.0, -0.75, 503.1), 200, 215), ((7.3, 0.0, 90.0, 0.0, -7.3, 510.0), 23, 25), ((0.02, 0.0, 162.0, 0.0, 0.03, 437.5), 150, 90)


@pytest.mark.parametrize("grid, places", [(FINER, 1 << 20), (FINER, 1 << 8), (FINER, 1), (COARSER, 1 << 20), (CLOSE, 1 << 20), (CLOSE, 1 << 12)])
@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_reproject_over_blocks(spark, monkeypatch, method, grid, places):
    """Blocks of 64 pixels and of few: missing and doubled pixels, places beyond the raster and over block edges."""
    monkeypatch.setattr(warp, "PLACES", places)
    rng, source = np.random.default_rng(8), (1.0, 0.0, 100.0, 0.0, -1.0, 500.0)
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(rng.normal(50, 20, (150, 139))) if rng.random() > 0.1]
    rows += [(70, 60 + c, 7.0) for c in range(9)] + [(-1, 3, 9.0)]
    pixels = {}
    for r, c, v in rows:
        pixels.setdefault((r, c), []).append(v)
    px = spark.createDataFrame([*rows, (90, 90, None)], "r bigint, c bigint, v double").orderBy(F.hash("r", "c"))
    keys = lambda t: (1.5 * t - 2.5) * t * t + 1 if t <= 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2 if t < 2 else 0.0
    want = mapped_back(pixels, source, grid, *(((0, 1), lambda t: 1 - t) if method == "bilinear" else ((-1, 2), keys)))
    got = warp.reproject(px, "", source, "", grid, method, (150, 139)).collect()
    assert len(got) == len(want) and {(x["r"], x["c"]) for x in got} == set(want)
    np.testing.assert_allclose([x["v"] for x in got], [want[x["r"], x["c"]] for x in got], rtol=1e-6, atol=1e-6)


def test_reproject_of_nothing(spark):
    px, t = spark.createDataFrame([(0, 0, 1.0)], "r bigint, c bigint, v double"), (1.0, 0.0, 0.0, 0.0, -1.0, 10.0)
    assert warp.reproject(px.limit(0), "", t, "", (t, 9, 9)).collect() == [] == warp.reproject(px, "", t, "", (t, 0, 0)).collect()
    # places that the source's system lacks have no pixel
    assert warp.reproject(px, "", t, "", ((1.0, 0.0, math.nan, 0.0, -1.0, 10.0), 3, 3)).collect() == []


def test_reproject_exchanges_packs(spark, monkeypatch):
    """Few rows are exchanged, and tasks follow from the pixels: no row for each pixel or each of the 16 it reads goes to a set number of tasks."""
    px = spark.range(200 * 300).select(F.expr("id div 300").alias("r"), (F.col("id") % 300).alias("c"), F.col("id").cast("double").alias("v"))
    t, context = (1.0, 0.0, 0.0, 0.0, -1.0, 200.0), spark.sparkContext
    fine = ((0.5, 0.0, 0.0, 0.0, -0.5, 200.0), 600, 400)
    try:
        context.setJobGroup("packs", "packs")
        assert warp.reproject(px, "", t, "", fine, "cubic").count() == 240000
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("packs") for s in tracker.getJobInfo(job).stageIds}
    done = [x for x in map(store.lastStageAttempt, stages) if x.status().toString() == "COMPLETE"]
    assert 0 < sum(x.shuffleWriteRecords() for x in done) < 24000
    monkeypatch.setattr(warp, "SHARE", 1 << 18)
    assert warp.reproject(px, "", t, "", fine, "cubic", (200, 300)).rdd.getNumPartitions() == -(-(24 * 240000 + 12 * 60000) // (1 << 18))
