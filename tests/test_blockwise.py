"""Block stencils, template search and selection against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import blockwise, focal, stats, vision
from thalweg.operators.composites import Raster, read_window, tile_at


def frame(spark, array, parts=3):
    rows = [(r, c, None if math.isnan(v) else float(v)) for r, row in enumerate(np.asarray(array).tolist()) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "r bigint, c bigint, v double").repartition(parts)


def back(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["r"], r["c"]] = r[name]
    return out


@pytest.fixture(scope="module")
def rough():
    rng = np.random.default_rng(4)
    x = rng.normal(100, 5, (37, 29))
    x[rng.random(x.shape) < 0.1] = np.nan
    return x


def test_pack_and_unpack(spark, rough):
    grid = blockwise.Grid(37, 29, 8)
    blocks = blockwise.pack(frame(spark, rough), grid)
    assert blocks.count() == 5 * 4
    np.testing.assert_array_equal(back(blockwise.unpack(blocks, grid), rough.shape), rough)


@pytest.mark.parametrize("edge", ["symmetric", "missing", "clip"])
@pytest.mark.parametrize("halo", [((3, 1), (2, 5)), ((20, 20), (9, 11)), ((0, 0), (0, 0))])
def test_halos(spark, rough, edge, halo):
    """Every region is the cut of the whole raster, padded as numpy pads it."""
    grid, (h, w) = blockwise.Grid(37, 29, 8), rough.shape
    pad = np.pad(rough, halo, mode="symmetric") if edge == "symmetric" else np.pad(rough, halo, constant_values=np.nan)

    def step(r0, c0, n, m, region):
        (t, b), (l, r) = halo
        want = pad[r0 : r0 + n + t + b, c0 : c0 + m + l + r]
        if edge == "clip":
            want = rough[max(0, r0 - t) : r0 + n + b, max(0, c0 - l) : c0 + m + r]
        return blockwise.pixel_table(r0, c0, {"v": np.full((n, m), float(np.array_equal(want, region, equal_nan=True)))})

    out = blockwise.neighbourhoods(blockwise.pack(frame(spark, rough), grid), grid, halo, step, "r bigint, c bigint, v double", edge)
    assert out.count() == h * w and out.filter("v <> 1").count() == 0


def plain_smooth(x, weights, axis):
    radius = len(weights) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (radius, radius)
    y = np.pad(x, pad, mode="symmetric")
    return np.apply_along_axis(lambda line: np.convolve(line, weights[::-1], "valid"), axis, y)


@pytest.mark.parametrize("sigma", [0.8, 6.0])
def test_low_pass(spark, rough, sigma, monkeypatch):
    monkeypatch.setattr(focal, "block_size", lambda radius: 8)
    weights = np.array([w for _, w in focal.gaussian_kernel(sigma)])
    full = np.where(np.isnan(rough), np.nanmean(rough), rough)
    want = np.where(np.isnan(rough), np.nan, plain_smooth(plain_smooth(full, weights, 0), weights, 1))
    np.testing.assert_allclose(back(focal.low_pass(frame(spark, rough), *rough.shape, sigma), rough.shape), want, atol=1e-9)


def test_smooth_along_skips_missing(spark, rough):
    kernel = [(-2, 0.1), (0, 0.5), (1, 0.4)]
    zeros = np.where(np.isnan(rough), 0.0, rough)
    for axis, n in (("r", 37), ("c", 29)):
        want = plain_smooth(zeros, np.array([0.1, 0, 0.5, 0.4, 0.0]), 0 if axis == "r" else 1)
        got = focal.smooth_along(frame(spark, rough), axis, n, kernel)
        np.testing.assert_allclose(np.nan_to_num(back(got, rough.shape)), want, atol=1e-9)


def test_exchange_is_near_one_copy(spark):
    """Strips of a halo of 2 beside blocks of 32: what is sent is little more than the raster, however wide the kernel."""
    grid = blockwise.Grid(128, 128, 32)
    sent = []
    for radius in (2, 8):
        parts = blockwise.neighbourhoods(blockwise.pack(frame(spark, np.ones((128, 128))), grid), grid, ((radius, radius), (radius, radius)), lambda r0, c0, h, w, region: blockwise.pixel_table(r0, c0, {"v": np.full((1, 1), float(region.size))}), "r bigint, c bigint, v double", "clip")
        sent.append(parts.agg(F.sum("v")).first()[0] / 128**2)
    assert sent[0] < 1.25 and sent[1] < 2.1


def test_gradients_and_hillshade_on_a_slope(spark, rough):
    got = focal.gradients(frame(spark, rough))
    down, right = (back(got, rough.shape, n) for n in ("dzdr", "dzdc"))
    want = np.full((2, *rough.shape), np.nan)
    want[0][1:-1, 1:-1] = (rough[2:, 1:-1] - rough[:-2, 1:-1]) / 2
    want[1][1:-1, 1:-1] = (rough[1:-1, 2:] - rough[1:-1, :-2]) / 2
    np.testing.assert_allclose(down, want[0])
    np.testing.assert_allclose(right, want[1])
    # a plane falling to the south east: 1 in 2 along columns, 1 in 4 along rows
    plane = 100 - 0.5 * np.arange(6) - 0.25 * np.arange(5)[:, None]
    shade = back(focal.hillshade(frame(spark, plane), 315, 45, 1.0), plane.shape, "shade")
    normal = np.array([0.5, -0.25, 1.0]) / math.sqrt(1 + 0.5**2 + 0.25**2)  # east, north, up
    sun = np.array([math.cos(math.radians(135)) * math.cos(math.pi / 4), math.sin(math.radians(135)) * math.cos(math.pi / 4), math.sin(math.pi / 4)])
    np.testing.assert_allclose(shade[1:-1, 1:-1], max(0.0, float(normal @ sun)), atol=1e-12)


def plain_scores(image, t):
    h, w = t.shape
    out = {}
    for r in range(image.shape[0] - h + 1):
        for c in range(image.shape[1] - w + 1):
            part = image[r : r + h, c : c + w]
            ok = ~np.isnan(part) & ~np.isnan(t)
            if ok.any():
                x, y = part[ok], t[ok]
                flat = np.ptp(x) == 0 or np.ptp(y) == 0
                out[r, c] = (None if flat else float(np.mean((x - x.mean()) * (y - y.mean())) / (x.std() * y.std())), int(ok.sum()))
    return out


@pytest.mark.parametrize("chunk", [8, 64])
def test_match_scores(spark, rough, chunk):
    image = rough.copy()
    image[5:15, 3:12] = 80.0  # flat places have no score
    t = image[20:27, 11:16].copy()
    t[0, 0] = np.nan
    got = {(r["dr"], r["dc"]): (r["score"], r["n"]) for r in vision.match_scores(frame(spark, t), frame(spark, image), 37, 29, 7, 5, chunk).collect()}
    want = plain_scores(image, t)
    assert got.keys() == want.keys()
    for k, (score, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (score is None)
        assert score is None or got[k][0] == pytest.approx(score, abs=1e-7)
    best = vision.best_match(vision.best_offsets(frame(spark, t), frame(spark, image), 37, 29, 7, 5, chunk)).first()
    assert (best["dr"], best["dc"], best["confident"]) == (20, 11, True)


def test_tile_at(spark):
    """A tile found in an image of many chunks, whole, in a part of it, and by a pyramid; ties go to the smaller offset."""
    rng = np.random.default_rng(8)
    image = np.kron(rng.normal(0, 20, (22, 18)), np.ones((8, 8)))[:170, :140] + rng.normal(0, 1, (170, 140))
    image[rng.random(image.shape) < 0.05] = np.nan
    t = image[83:115, 37:66]
    raster, tile = Raster(frame(spark, image), *image.shape), frame(spark, t)
    for kw in ({}, {"search": (60, 20, 160, 120)}, {"pyramid": 4}, {"pyramid": 4, "search": (60, 20, 160, 120)}):
        best = tile_at(raster, tile, t.shape, **kw).first()
        assert (best["dr"], best["dc"]) == (83, 37) and best["score"] == pytest.approx(1)
    twice = np.tile(rng.normal(0, 1, (12, 12)), (4, 4))
    best = tile_at(Raster(frame(spark, twice), 48, 48), frame(spark, twice[:12, :12]), (12, 12)).first()
    assert (best["dr"], best["dc"]) == (0, 0)
    with pytest.raises(ValueError, match="TEMPLATE_MOST"):
        vision.match_scores(tile, raster.px, 1 << 20, 1 << 20, 1 << 13, 1 << 13)


def test_resize_by_index(spark):
    """Pixels that are absent leave a hole, and don't move the others."""
    ramp = [(0, c, float(c)) for c in range(9) if c != 3]
    df = spark.createDataFrame(ramp, "r bigint, c bigint, v double")
    for step in (focal.resize_cubic, focal.resize_linear):
        got = {r["c"]: r["v"] for r in step(df, "c", 9, 9).collect()}
        assert got.get(3) is None and all(got[c] == pytest.approx(c) for c in range(9) if c != 3)
        half = {r["c"]: r["v"] for r in step(df, "c", 9, 17).collect()}
        assert [c for c in range(17) if half.get(c) is None] == [5, 6, 7]
        one = [r["v"] for r in step(df, "c", 9, 1).collect()]
        assert one == pytest.approx([0.0])
        single = [r["v"] for r in step(spark.createDataFrame([(0, 0, 7.0)], "r bigint, c bigint, v double"), "c", 1, 4).collect()]
        assert single == pytest.approx([7.0] * 4)


def test_window_to_one_row(spark):
    raster = Raster(frame(spark, np.arange(24.0).reshape(4, 6)), 4, 6)
    out = read_window(raster, (0, -4, 6, 0), (1, 6))
    assert [r["v"] for r in out.px.orderBy("c").collect()] == pytest.approx([0, 1, 2, 3, 4, 5])


SHARES = (0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0)


@pytest.mark.parametrize("held", [20_000, 7])
def test_quantiles(spark, monkeypatch, held):
    """Selection equals a sort: normal, skewed, tied, two-valued, tiny and huge ranges, one value, repeated in classes."""
    monkeypatch.setattr(stats, "HELD", held)
    monkeypatch.setattr(stats, "CELLS", 16 if held < 100 else 1024)
    rng = np.random.default_rng(6)
    data = {
        "normal": rng.normal(0, 1, 500), "skewed": np.exp(rng.normal(0, 8, 400)), "ties": rng.integers(0, 3, 300).astype(float), "two": np.r_[np.zeros(50), 1.0], "one": np.array([4.5]),
        "tiny": 1 + np.arange(40) * 2.3e-16, "huge": np.r_[-1.7e308, rng.normal(0, 1e307, 60), 1.7e308], "same": np.full(90, -2.0),
    }
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("normal", None), ("normal", float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = stats.quantiles(df, "v", SHARES, "k")
    for k, xs in data.items():
        assert got[k][0] == len(xs)
        with np.errstate(over="ignore"):
            want = [np.quantile(xs / 4, q) * 4 for q in SHARES]
        np.testing.assert_allclose(got[k][1], want, rtol=1e-12, atol=1e-300)
    assert stats.quantiles(df.filter("k = 'ties'"), "v", (0.5,))[None][1] == [float(np.median(data["ties"]))]
    assert stats.quantiles(df.limit(0), "v", (0.5,)) == {}
    assert [r["value"] for r in stats.percentiles(df.limit(0), "v", (5, 50)).collect()] == [None, None]
    with pytest.raises(ValueError, match="infinite"):
        stats.quantiles(spark.createDataFrame([(math.inf,), (1.0,)], "v double"), "v", (0.5,))
    with pytest.raises(ValueError, match="classes"):
        stats.quantiles(spark.range(100).select("id", F.lit(1.0).alias("v")), "v", (0.5,), "id")


def test_numbered_on_a_skewed_key(spark):
    """Half of the rows share a key, the others crowd at one end: numbers are right and no range has more than twice the mean."""
    keys = [5.0] * 4000 + [1e9] + [1.0 + i * 1e-6 for i in range(4000)] + [None] * 3
    df = spark.createDataFrame([(k,) for k in keys], "k double").repartition(6)
    rows = stats.numbered(df, "k").collect()
    assert sorted(r["rn"] for r in rows) == list(range(1, len(keys) + 1))
    want = sorted(keys, key=lambda k: (k is not None, k))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["rn"])] == want
    ids = spark.createDataFrame([(k,) for k in keys], "k double").repartition(6).withColumn("t", F.monotonically_increasing_id()).repartitionByRange(F.col("k"), "t")
    sizes = [r["count"] for r in ids.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * len(keys) / len(sizes)
