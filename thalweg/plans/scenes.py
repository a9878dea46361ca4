"""Queries over whole scenes: search, stencils, selection, files and rasters of unlike grids, on the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import shared
from ..functions import algebra as A
from ..operators import blockwise, focal, spatial, stats, zones
from ..operators import composites as C
from ..sources import files as sources
from . import bindings as B
from .queries import CENTRES, R, _centres, _height, query
from .workflows import _raster

# search


def _template(x, top: int, left: int, h: int, w: int):
    return x.filter(F.col("r").between(top, top + h - 1) & F.col("c").between(left, left + w - 1)).select((F.col("r") - top).alias("r"), (F.col("c") - left).alias("c"), "v")


@query(f"""WITH {B.grid_sql(10)}, t AS (SELECT r-120 AS tr, c-4 AS tc, v AS t FROM dsm WHERE r BETWEEN 120 AND 183 AND c BETWEEN 4 AND 27), h AS (SELECT max(r)+1 AS h FROM dsm), s AS (SELECT d.r-tr AS dr, d.c-tc AS dc, count(*) AS n, covar_pop(t, v)/(stddev_pop(t)*stddev_pop(v)) AS score FROM dsm d, t, h WHERE d.r-tr BETWEEN 0 AND h-64 AND d.c-tc BETWEEN 0 AND 8 AND t IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)
  SELECT dr, dc, {R('score')} AS score, score >= CAST(0.7 AS DOUBLE) AS confident FROM s ORDER BY s.score DESC, dr, dc LIMIT 1""")
def tile_search(spark, d):
    """A tile of 64 x 24 pixels, with missing ones, in the whole image."""
    image = _raster(spark, d, "dsm")
    best = C.tile_at(image, _template(image.px, 120, 4, 64, 24), (64, 24))
    return best.select("dr", "dc", A.tidy(F.col("score")).alias("score"), "confident")


@query(f"WITH {B.POINTS_SQL}, centres AS ({CENTRES}), far AS (SELECT block, cx*10-300 AS cx, cy*3-100 AS cy FROM centres), k AS (SELECT block, id, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS dist FROM far, points) SELECT block, id, row_number() OVER (PARTITION BY block ORDER BY dist, id) AS rank, {R('dist')} AS dist FROM k QUALIFY rank <= 12")
def knn_anywhere(spark, d):
    """J10 without a radius: centres inside and far outside of the raster."""
    centres = _centres(spark, d).select("block", (F.col("cx") * 10 - 300).alias("cx"), (F.col("cy") * 3 - 100).alias("cy"))
    return spatial.knn(centres, B.points(spark, d), 12, 256).select("block", "id", F.col("rank").cast("bigint").alias("rank"), A.tidy(F.col("dist")).alias("dist"))


# stencils

SUN = "cos(radians(CAST(135 AS DOUBLE)))*cos(radians(CAST(45 AS DOUBLE))) AS ex, sin(radians(CAST(135 AS DOUBLE)))*cos(radians(CAST(45 AS DOUBLE))) AS nx, sin(radians(CAST(45 AS DOUBLE))) AS up"


@query(f"""WITH {B.grid_sql(10)}, s AS (SELECT {SUN}), g AS (SELECT a.r, a.c, (e.v - w.v)/2*2 AS dx, -(n.v - s.v)/2*2 AS dy FROM dsm a JOIN dsm n ON n.r = a.r+1 AND n.c = a.c JOIN dsm s ON s.r = a.r-1 AND s.c = a.c JOIN dsm e ON e.r = a.r AND e.c = a.c+1 JOIN dsm w ON w.r = a.r AND w.c = a.c-1)
  SELECT r, c, CASE WHEN dx + dy IS NOT NULL THEN {R('greatest(0, (up - dx*ex - dy*nx)/sqrt(1 + dx*dx + dy*dy))')} END AS shade FROM g, s""")
def hillshade(spark, d):
    """W6."""
    return focal.hillshade(B.raster(spark, d, 10, "dsm"), height=_height(spark, d), width=32).select("r", "c", A.tidy(F.col("shade")).alias("shade"))


# selection

LEVELS = (1, 10, 50, 90, 99)


@query(f"WITH {B.METHODS3_SQL}, q AS (SELECT method, quantile_cont(v, {[p / 100 for p in LEVELS]}) AS q FROM m3 WHERE v IS NOT NULL GROUP BY method), u AS (SELECT method, unnest(q) AS v, unnest({list(LEVELS)}) AS pct FROM q) SELECT method, pct, {R('v')} AS value FROM u")
def method_percentiles(spark, d):
    """A5 for each raster by selection."""
    found = stats.quantiles(B.methods3(spark, d), "v", tuple(p / 100 for p in LEVELS), "method")
    rows = [(m, p, x) for m, (_, xs) in found.items() for p, x in zip(LEVELS, xs, strict=True)]
    return spark.createDataFrame(rows, "method string, pct int, value double").select("method", "pct", A.tidy(F.col("value")).alias("value"))


# files


@query(f"WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm) SELECT r - 40 AS r, c - 5 AS c, {R('CAST(v AS FLOAT)')} AS v FROM dsm, h WHERE r BETWEEN 40 AND h - 51 AND c BETWEEN 5 AND 29")
def geotiff_window(spark, d):
    """The raster written as one tiled GeoTIFF by all tasks, a window of it read again."""
    path = f"{shared.folder(spark)}/raster-{uuid.uuid4().hex}.tif"
    raster = _raster(spark, d, "dsm")
    C.save_raster(raster, path, 32, predictor=3)
    part = C.load_raster(spark, path, window=(40, 5, raster.height - 50, 30))
    return part.px.select("r", "c", A.tidy(F.col("v")).alias("v"))


@query(f"WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm) SELECT CAST(floor(r/100) AS BIGINT) AS grid, CAST(r % 100 AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('500 + (c + CAST(0.5 AS DOUBLE))*2')} AS x, {R('9000 - (r + CAST(0.5 AS DOUBLE))*2')} AS y, {R('v')} AS v FROM dsm, h")
def ascii_grids(spark, d):
    """The raster as ASCII grids of 100 rows, read again by byte ranges."""
    path = f"{shared.folder(spark)}/grids-{uuid.uuid4().hex}"
    sources.write_ascii(B.raster(spark, d, 10, "dsm"), path, (2.0, 0.0, 500.0, 0.0, -2.0, 9000.0), 32, _height(spark, d), 100)
    px = sources.ascii_pixels(spark, f"{path}/*/*.txt")
    return px.select(F.regexp_extract("path", r"grid=(\d+)", 1).cast("bigint").alias("grid"), "r", "c", *[A.tidy(F.col(x)).alias(x) for x in ("x", "y", "v")])


# rasters of unlike grids

# The second raster has pixels of 3, lies 5 to the right and 4 below the first, and lacks what its mean would round to.
COARSE_SQL = f"""{B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm), coarse AS (SELECT CAST(floor(r/3) AS BIGINT) AS r, CAST(floor(c/3) AS BIGINT) AS c, CASE WHEN count(v) = 9 THEN avg(v) END AS v FROM dtm GROUP BY 1, 2),
  tl AS (SELECT i*2 + j AS tile, j*12 - 2 AS l, h - i*12 AS t FROM range(100000) x(i), range(2) y(j), h WHERE i*12 < h),
  wa AS (SELECT tile, h - t AS r0, l AS c0, h - t + 16 AS r1, l + 16 AS c1 FROM tl, h),
  wb AS (SELECT tile, CAST(floor((h - 4 - t)/CAST(3 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS r0, CAST(floor((l - 5)/CAST(3 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS c0 FROM tl, h),
  a AS (SELECT tile, count(v) AS n FROM wa JOIN dsm ON r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY tile), b AS (SELECT tile, count(v) AS n FROM wb JOIN coarse ON r >= r0 AND r < r0 + 5 AND c >= c0 AND c < c0 + 5 GROUP BY tile)"""


@query(f"WITH {COARSE_SQL} SELECT tile, a.n AS n_a, b.n AS n_b, {R('100.0*a.n/256')} AS pct_a, {R('100.0*b.n/25')} AS pct_b FROM a JOIN b USING (tile) WHERE a.n >= 8 AND b.n >= 8")
def usable_tiles(spark, d):
    """Tiles with 8 valid pixels in a fine and in a coarse raster elsewhere."""
    h = _height(spark, d)
    fine = B.raster(spark, d, 10, "dsm")
    third = lambda x: F.floor(F.col(x) / 3).cast("bigint").alias(x)
    coarse = B.raster(spark, d, 10, "dtm").groupBy(third("r"), third("c")).agg(F.when(F.count("v") == 9, F.avg("v")).alias("v"))

    def stored(px, height: int, width: int, transform: tuple) -> zones.Stored:
        grid = blockwise.Grid(height, width, 8)
        blocks = shared.written(blockwise.raster_blocks(blockwise.pack(px, grid), grid, "x"), "blocks")
        return zones.Stored(blocks, height, width, transform, 8, shared.written(zones.zone_map(blocks), "zones"))

    a = stored(fine, h, 32, (1.0, 0.0, 0.0, 0.0, -1.0, float(h)))
    b = stored(coarse, -(-h // 3), 11, (3.0, 0.0, 5.0, 0.0, -3.0, float(h - 4)))
    left, top = (F.col("id") % 2 * 12 - 2).cast("double"), (h - F.floor(F.col("id") / 2) * 12).cast("double")
    tiles = spark.range(2 * -(-h // 12)).select(F.col("id").alias("tile"), left.alias("left"), (top - 16).alias("bottom"), (left + 16).alias("right"), top.alias("top"))
    out = zones.usable_tiles(tiles, a, b, 8)
    return out.select("tile", "n_a", "n_b", A.tidy(F.col("pct_a")).alias("pct_a"), A.tidy(F.col("pct_b")).alias("pct_b"))


# resampling

KEYS = "CASE WHEN abs({d}) <= 1 THEN (1.5::DOUBLE*abs({d}) - 2.5::DOUBLE)*abs({d})*abs({d}) + 1 WHEN abs({d}) < 2 THEN ((-0.5::DOUBLE*abs({d}) + 2.5::DOUBLE)*abs({d}) - 4)*abs({d}) + 2 ELSE 0 END"


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm), t AS (SELECT x.i AS row, y.j AS col, CAST(2.5 AS DOUBLE) + (x.i + CAST(0.5 AS DOUBLE))*CAST(0.75 AS DOUBLE) AS sr, CAST(1.75 AS DOUBLE) + (y.j + CAST(0.5 AS DOUBLE))*CAST(0.75 AS DOUBLE) AS sc FROM range(1000000) x(i), range(36) y(j), h WHERE x.i < CAST(floor((h - 6)/CAST(0.75 AS DOUBLE)) AS BIGINT)),
  k AS (SELECT row, col, CAST(floor(sr) AS BIGINT) + a AS r, CAST(floor(sc) AS BIGINT) + b AS c, sr, sc FROM t, range(-1, 3) p(a), range(-1, 3) q(b)),
  w AS (SELECT row, col, ({KEYS.format(d='(sr - k.r)')})*({KEYS.format(d='(sc - k.c)')}) AS w, v FROM k JOIN dsm ON dsm.r = k.r AND dsm.c = k.c WHERE v IS NOT NULL)
  SELECT row AS r, col AS c, {R('58 + sum(w*v)/sum(w)')} AS v FROM w GROUP BY row, col HAVING abs(sum(w)) > 1e-9""")
def warped(spark, d):
    """Cubic onto a finer grid elsewhere, heights shifted to the other datum."""
    raster = _raster(spark, d, "dsm")
    h = raster.height
    target = C.Raster(raster.px.limit(0), int((h - 6) // 0.75), 36, (0.75, 0.0, 2.25, 0.0, -0.75, float(h - 3)))
    return C.warp_to(raster, target, "cubic", 58.0).px.select("r", "c", A.tidy(F.col("v")).alias("v"))


def _depths_sql(name: str, ceiling: int) -> str:
    d = f"dsm - {name}"
    ok = f"FILTER (m > 127 AND {d} > 0 AND {d} < {ceiling})"
    return f"count({d}) {ok} AS {name}_valid, {R(f'avg({d}) {ok}')} AS {name}_depth_mean, {R(f'median({d}) {ok}')} AS {name}_depth_median, {R(f'stddev_pop({d}) {ok}')} AS {name}_depth_std"


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h, CAST(ceil((max(r)+1)/CAST(4 AS DOUBLE)) AS BIGINT) AS hc FROM dsm), cc AS (SELECT CAST(floor(r/4) AS BIGINT) AS r, CAST(floor(c/4) AS BIGINT) AS c, CASE WHEN count(v) > 14 THEN avg(v) END AS v FROM dtm GROUP BY 1, 2),
  f AS (SELECT r, c, coalesce(v, (SELECT avg(v) FROM cc)) AS v, CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END AS g FROM cc),
  tr AS (SELECT i AS r, i*(CAST(hc-1 AS DOUBLE)/(h-1)) AS p, hc FROM range(1000000) x(i), h WHERE i < h), ar AS (SELECT r, CAST(least(floor(p), hc-2) AS BIGINT) AS lo, p - least(floor(p), hc-2) AS w FROM tr),
  ac AS (SELECT i AS c, CAST(least(floor(i*(CAST(7 AS DOUBLE)/31)), 6) AS BIGINT) AS lo, i*(CAST(7 AS DOUBLE)/31) - least(floor(i*(CAST(7 AS DOUBLE)/31)), 6) AS w FROM range(32) y(i)),
  up AS (SELECT ar.r, ac.c, sum(v*abs(1 - dr - ar.w)*abs(1 - dc - ac.w)) AS v, sum(g*abs(1 - dr - ar.w)*abs(1 - dc - ac.w)) AS g FROM ar, ac, range(2) a(dr), range(2) b(dc), f WHERE f.r = ar.lo + dr AND f.c = ac.lo + dc GROUP BY ar.r, ac.c),
  x AS (SELECT dsm, dtm AS fine, CASE WHEN g <= CAST(0.5 AS DOUBLE) THEN up.v END AS coarse, (pair.r*31 + pair.c*17) % 256 AS m FROM pair JOIN up USING (r, c))
  SELECT count(coarse - fine) AS n, {R('avg(coarse - fine)')} AS dtm_diff_mean, {R('stddev_pop(coarse - fine)')} AS dtm_diff_std, {_depths_sql('fine', 10)}, {_depths_sql('coarse', 5)} FROM x""")
def source_comparison(spark, d):
    """One tile's depths against its terrain model and against a coarse one with gaps, of another datum."""
    h, dsm, dtm = _height(spark, d), B.raster(spark, d, 10, "dsm"), B.raster(spark, d, 10, "dtm")
    fourth = lambda x: F.floor(F.col(x) / 4).cast("bigint").alias(x)
    coarse = dtm.groupBy(fourth("r"), fourth("c")).agg((F.when(F.count("v") > 14, F.avg("v")) - 58).alias("v"))
    mask = dsm.select("r", "c", ((F.col("r") * 31 + F.col("c") * 17) % 256).alias("v"))
    return C.compare_dtm_sources(mask, dsm, dtm, C.Raster(coarse, -(-h // 4), 8), (h, 32), 58.0, "bilinear")


def _spline_sql(src: str, out: str, axis: str, n_in: str, n_out: str) -> str:
    """CTEs that read a cubic B-spline, mirrored at its ends, through one axis of src (r, c, v) at n_out places."""
    other = "c" if axis == "r" else "r"
    mirror = lambda q, n: f"CASE WHEN {q} % (2*{n} - 2) > {n} - 1 THEN 2*{n} - 2 - {q} % (2*{n} - 2) ELSE {q} % (2*{n} - 2) END"
    return f"""{out}_k AS (SELECT i AS k, pow(z, abs(i))*(-6*z/(1 - z*z)) AS w FROM range(-30, 31) x(i), (SELECT sqrt(CAST(3 AS DOUBLE)) - 2 AS z)),
  {out}_w AS (SELECT f.{other}, n.i, sum(n.w*f.v) AS v FROM (SELECT i, w, {mirror('(i + k + 60*(2*' + n_in + ' - 2))', n_in)} AS q FROM range(1000000) x(i), {out}_k, d WHERE i < {n_in}) n JOIN {src} f ON f.{axis} = n.q GROUP BY f.{other}, n.i),
  {out}_t AS (SELECT i AS t, i*(CAST({n_in} - 1 AS DOUBLE)/({n_out} - 1)) AS p FROM range(1000000) x(i), d WHERE i < {n_out}),
  {out}_u AS (SELECT t, CAST(least(floor(p), {n_in} - 2) AS BIGINT) AS lo, p - least(floor(p), {n_in} - 2) AS x FROM {out}_t, d),
  {out}_b AS (SELECT t, {mirror('abs(lo + j - 1)', n_in)} AS q, CASE j WHEN 0 THEN pow(1-x, 3)/6 WHEN 1 THEN (3*pow(x, 3) - 6*x*x + 4)/6 WHEN 2 THEN (-3*pow(x, 3) + 3*x*x + 3*x + 1)/6 ELSE pow(x, 3)/6 END AS w FROM {out}_u, range(4) y(j), d),
  {out} AS (SELECT {out}_w.{other}, b.t AS {axis}, sum(b.w*{out}_w.v) AS v FROM {out}_b b JOIN {out}_w ON {out}_w.i = b.q GROUP BY {out}_w.{other}, b.t)"""


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm), box AS (SELECT min(r) AS r0, max(r)+1 AS r1, min(c) AS c0, max(c)+1 AS c1 FROM dsm, h WHERE v IS NOT NULL AND r BETWEEN 10 AND h - 9 AND c BETWEEN 2 AND 25),
  d AS (SELECT h, CAST(floor(r0/CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(c0/CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS b, CAST(floor((r1 - r0)/CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS hp, CAST(floor((c1 - c0)/CAST(4 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS wp FROM box, h),
  cc AS (SELECT CAST(floor(r/4) AS BIGINT) AS r, CAST(floor(c/4) AS BIGINT) AS c, CASE WHEN count(v) > 14 THEN avg(v) END AS v FROM dtm GROUP BY 1, 2), part AS (SELECT r - a AS r, c - b AS c, v FROM cc, d WHERE r >= a AND r < a + hp AND c >= b AND c < b + wp),
  f AS (SELECT r, c, coalesce(v, (SELECT avg(v) FROM part)) AS v FROM part), {_spline_sql('f', 'x1', 'r', 'hp', 'h')}, {_spline_sql('x1', 'x2', 'c', 'wp', '32')} SELECT r, c, {R('v')} AS v FROM x2""")
def bicubic_matched(spark, d):
    """A coarse model of another datum, cut to the valid part of a fine one and resampled to its grid."""
    h, dtm = _height(spark, d), B.raster(spark, d, 10, "dtm")
    fourth = lambda x: F.floor(F.col(x) / 4).cast("bigint").alias(x)
    coarse = dtm.groupBy(fourth("r"), fourth("c")).agg((F.when(F.count("v") > 14, F.avg("v")) - 58).alias("v"))
    inside = F.col("r").between(10, h - 9) & F.col("c").between(2, 25)
    fine = C.Raster(B.raster(spark, d, 10, "dsm").withColumn("v", F.when(inside, F.col("v"))), h, 32, (1.0, 0.0, 0.0, 0.0, -1.0, float(h)))
    out = C.bicubic_matched(fine, C.Raster(coarse, -(-h // 4), 8, (4.0, 0.0, 0.0, 0.0, -4.0, float(h))), 58.0)
    return out.px.select("r", "c", A.tidy(F.col("v")).alias("v"))
