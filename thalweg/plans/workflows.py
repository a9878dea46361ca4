"""A query for each workflow (V9-V27) on the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra as A
from ..operators import composites as C
from ..operators import focal
from . import bindings as B
from .queries import CORR, R, _height, query

# Tiles of 20 rows of the two rasters. Some have no mask, no water, no surface or no terrain model, so that every outcome arises.
TILES_SQL = (
    B.grid_sql(10)
    + f""", cells AS (SELECT CAST(floor(r/20) AS BIGINT) AS tile, r % 20 AS r, c, dsm, dtm, (r*31 + c*17) % 256 AS m FROM pair),
  masks AS (SELECT tile, r, c, CASE WHEN tile % 11 = 5 THEN m % 128 ELSE m END AS v FROM cells WHERE tile % 11 <> 3), surf AS (SELECT tile, r, c, CASE WHEN tile % 11 <> 7 THEN dsm END AS v FROM cells),
  mm AS (SELECT unnest(['webodm','bluesky','fusion','kriged']) AS method, unnest([0,1,2,3]) AS rnk),
  beds AS (SELECT tile, method, r, c, CASE method WHEN 'webodm' THEN dtm WHEN 'bluesky' THEN dtm - 1 WHEN 'fusion' THEN dtm - CAST(c AS DOUBLE)/8 ELSE dtm + 60 END + CASE WHEN tile % 11 = 1 THEN CAST(60 AS DOUBLE) ELSE 0 END AS v FROM cells, mm WHERE tile % 11 <> 9 AND (method <> 'fusion' OR c < 20)),
  star AS (SELECT w.tile, b.method, s.v AS surface, b.v AS riverbed, s.v - b.v AS depth FROM masks w JOIN surf s USING (tile, r, c) JOIN beds b USING (tile, r, c) WHERE w.v > 127),
  g AS (SELECT tile, method, {{aggs}} FROM star GROUP BY tile, method),
  t AS (SELECT t.tile, mm.method, mm.rnk, i.n_water, d.n_dsm FROM (SELECT DISTINCT tile FROM cells) t CROSS JOIN mm LEFT JOIN (SELECT tile, count(*) FILTER (v > 127) AS n_water FROM masks GROUP BY tile) i USING (tile) LEFT JOIN (SELECT tile, count(v) AS n_dsm FROM surf GROUP BY tile) d USING (tile)),
  td AS (SELECT t.tile, t.method, t.rnk AS rank, CASE WHEN n_water IS NULL THEN 'mask_not_found' WHEN n_water = 0 THEN 'no_water' WHEN coalesce(n_dsm, 0) = 0 THEN 'no_dsm' WHEN max(valid_pixels) OVER (PARTITION BY t.tile) IS NULL THEN 'no_valid_dtms' WHEN max(valid_pixels) OVER (PARTITION BY t.tile) = 0 THEN 'no_valid_depths' ELSE 'ok' END AS status,
    coalesce(n_water, 0) AS water_pixels, coalesce(valid_pixels, 0) AS valid_pixels, CASE WHEN n_water > 0 THEN {R('100.0*coalesce(valid_pixels, 0)/n_water')} END AS coverage_pct, {{names}} FROM t LEFT JOIN g ON g.tile = t.tile AND g.method = t.method)"""
)
_OK = "FILTER (depth > 0 AND depth < 5)"
_AGGS = {f"{n}_{k}": R(f"{f}({n}) {_OK}") for n, ks in (("depth", ("mean", "median", "std", "min", "max")), ("surface", ("mean", "std")), ("riverbed", ("mean", "std"))) for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) if k in ks}
TILES_SQL = TILES_SQL.replace("{aggs}", f"count(*) {_OK} AS valid_pixels, " + ", ".join(f"{x} AS {n}" for n, x in _AGGS.items())).replace("{names}", ", ".join(_AGGS))


def _tiled(spark, d):
    tile = lambda t: t.withColumn("tile", F.floor(F.col("r") / 20).cast("bigint")).withColumn("r", F.col("r") % 20)
    kind = F.col("tile") % 11
    dsm, dtm = tile(B.raster(spark, d, 10, "dsm")), tile(B.raster(spark, d, 10, "dtm"))
    m = ((F.col("tile") * 20 + F.col("r")) * 31 + F.col("c") * 17) % 256
    masks = dsm.select("tile", "r", "c", F.when(kind == 5, m % 128).otherwise(m).alias("v")).filter(kind != 3)
    v, c = F.col("v"), F.col("c")
    models = F.array(*[F.struct(F.lit(n).alias("method"), (x + F.when(kind == 1, 60.0).otherwise(0.0)).alias("v")) for n, x in (("webodm", v), ("bluesky", v - 1), ("fusion", v - c.cast("double") / 8), ("kriged", v + 60))])
    beds = dtm.select("tile", "r", "c", F.explode(models).alias("x")).select("tile", "r", "c", "x.*").filter((kind != 9) & ((F.col("method") != "fusion") | (c < 20)))
    return C.tile_depths(dsm.select("tile").distinct(), masks, dsm.select("tile", "r", "c", F.when(kind != 7, v).alias("v")), beds)


@query(f"WITH {TILES_SQL} SELECT * FROM td")
def tile_depth_join(spark, d):
    return _tiled(spark, d)


@query(f"WITH {TILES_SQL} SELECT status, count(DISTINCT tile) AS tiles FROM td GROUP BY status")
def tile_outcomes(spark, d):
    return C.outcomes(_tiled(spark, d))


@query("SELECT doc_id AS tile, CAST(floor(doc_id/82) AS BIGINT)*768 AS pixel_row, doc_id % 82 * 768 AS pixel_col, CAST(500000 AS DOUBLE) + (doc_id % 82 * 768)*CAST(0.5 AS DOUBLE) AS \"left\", CAST(5750000 AS DOUBLE) - (floor(doc_id/82)*768 + 1024)*CAST(0.5 AS DOUBLE) AS bottom, CAST(500000 AS DOUBLE) + (doc_id % 82 * 768 + 1024)*CAST(0.5 AS DOUBLE) AS \"right\", CAST(5750000 AS DOUBLE) - floor(doc_id/82)*768*CAST(0.5 AS DOUBLE) AS top FROM documents")
def georeference(spark, d):
    """The documents' numbers as tiles."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("tile"))
    return t.select("tile", *C.georeference(F.col("tile"), 63600, (0.5, 0.0, 500000.0, 0.0, -0.5, 5750000.0)))


# terrain models


@query(f"""WITH {B.grid_sql(10)}, m AS (SELECT avg(v) AS m, max(r)+1 AS h FROM dsm), f AS (SELECT r, c, coalesce(v, m) AS v FROM dsm, m), kk AS (SELECT i AS k, exp(-CAST(i*i AS DOUBLE)/8) AS w FROM range(-8, 9) x(i)), kn AS (SELECT k, w/(SELECT sum(w) FROM kk) AS w FROM kk),
  s1 AS (SELECT s.r, s.c, sum(w*f.v) AS v FROM (SELECT r, c, w, CASE WHEN r+k < 0 THEN -1-(r+k) WHEN r+k >= h THEN 2*h-1-(r+k) ELSE r+k END AS q FROM dsm, kn, m) s JOIN f ON f.r = s.q AND f.c = s.c GROUP BY s.r, s.c),
  s2 AS (SELECT s.r, s.c, sum(w*s1.v) AS low FROM (SELECT r, c, w, CASE WHEN c+k < 0 THEN -1-(c+k) WHEN c+k >= 32 THEN 63-(c+k) ELSE c+k END AS q FROM dsm, kn) s JOIN s1 ON s1.c = s.q AND s1.r = s.r GROUP BY s.r, s.c),
  p AS (SELECT r, c, CASE WHEN dsm - dtm IS NOT NULL THEN least(50, greatest(0, dsm - dtm)) END AS h, dtm, dsm - low AS detail FROM pair JOIN s2 USING (r, c))
  SELECT r, c, {R('h')} AS ndsm, {R('exp(-h/2)')} AS alpha, {R('detail')} AS detail, {R('dtm + exp(-h/2)*detail')} AS fused FROM p""")
def fusion(spark, d):
    """V19 with the true low-pass: two passes of the Gaussian."""
    out = C.run_fusion(B.raster(spark, d, 10, "dsm"), B.raster(spark, d, 10, "dtm"), _height(spark, d), 32, 2.0)
    return out.select("r", "c", *[A.tidy(F.col(x)).alias(x) for x in ("ndsm", "alpha", "detail", "fused")])


@query(f"""WITH {B.grid_sql(10)}, m AS (SELECT avg(v) AS m, sqrt(CAST(3 AS DOUBLE)) - 2 AS z FROM dsm), f AS (SELECT r, c, coalesce(v, m) AS v FROM dsm, m), kk AS (SELECT i AS k, pow(z, abs(i)) * (-6*z/(1 - z*z)) AS w FROM range(-30, 31) x(i), m),
  n AS (SELECT i, w, ((i + k) % 62 + 62) % 62 AS q FROM range(32) x(i), kk), sw AS (SELECT f.r, n.i, sum(n.w*f.v) AS v FROM n JOIN f ON f.c = CASE WHEN q > 31 THEN 62 - q ELSE q END GROUP BY f.r, n.i),
  t AS (SELECT i AS t, i*(CAST(31 AS DOUBLE)/79) AS p FROM range(80) x(i)), u AS (SELECT t, CAST(least(floor(p), 30) AS BIGINT) AS lo, p - least(floor(p), 30) AS x FROM t),
  b AS (SELECT t, abs(lo + j - 1) AS q, CASE j WHEN 0 THEN pow(1-x, 3)/6 WHEN 1 THEN (3*pow(x, 3) - 6*x*x + 4)/6 WHEN 2 THEN (-3*pow(x, 3) + 3*x*x + 3*x + 1)/6 ELSE pow(x, 3)/6 END AS w FROM u, range(4) y(j))
  SELECT sw.r, b.t AS c, {R('sum(b.w*sw.v)')} AS v FROM b JOIN sw ON sw.i = CASE WHEN b.q > 31 THEN 62 - b.q ELSE b.q END GROUP BY sw.r, b.t""")
def resize_cubic(spark, d):
    t = B.raster(spark, d, 10, "dsm")
    full = t.crossJoin(F.broadcast(t.agg(F.avg("v").alias("m")))).select("r", "c", F.coalesce("v", "m").alias("v"))
    return focal.resize_cubic(full, "c", 32, 80).select("r", "c", A.tidy(F.col("v")).alias("v"))


@query()
def fusion_based_kriging(spark, d):
    """The raster from itself on a grid four times coarser, with its errors."""
    _, errors = C.run_fusion_based_kriging(_raster(spark, d, "dsm"), 4, size=64, halo=8)
    return errors


# validation and comparison


def _raster(spark, d, which, step: float = 1.0, left: float = 0.0, top: float | None = None) -> C.Raster:
    h = _height(spark, d)
    return C.Raster(B.raster(spark, d, 10, which), h, 32, (step, 0.0, left, 0.0, -step, step * h if top is None else top))


FINDINGS_SQL = f"""m AS (SELECT count(*) AS total, count(dsm - dtm) AS n_both, count(dsm) AS n_dsm, count(dtm) AS n_dtm, min(dsm) AS s0, max(dsm) AS s1, min(dtm) AS t0, max(dtm) AS t1, count(*) FILTER (dsm - dtm < CAST(-0.1 AS DOUBLE)) AS bad, count(*) FILTER (dsm - dtm > 50) AS tall FROM pair),
  p AS (SELECT *, 100.0*bad/n_both AS vp, 100.0*n_both/total AS cp, 100.0 - 100.0*n_dsm/total AS gs, 100.0 - 100.0*n_dtm/total AS gt FROM m),
  q AS (SELECT quantile_cont(dsm - dtm, 0.25) AS a, quantile_cont(dsm - dtm, 0.75) AS b FROM pair), o AS (SELECT 100.0*count(*) FILTER (dsm - dtm < a - 3*(b-a) OR dsm - dtm > b + 3*(b-a))/count(dsm - dtm) AS op FROM pair, q),
  found AS (SELECT 'dsm_range' AS "check", CASE WHEN s0 < -100 OR s1 > 5000 OR s1 - s0 > 1000 THEN 'warning' ELSE 'passed' END AS severity, {R('s1 - s0')} AS metric FROM p
  UNION ALL SELECT 'dtm_range', CASE WHEN t0 < -100 OR t1 > 5000 OR t1 - t0 > 1000 THEN 'warning' ELSE 'passed' END, {R('t1 - t0')} FROM p
  UNION ALL SELECT 'height_logic', CASE WHEN vp > 5 THEN 'issue' WHEN vp > 1 THEN 'warning' ELSE 'passed' END, {R('vp')} FROM p
  UNION ALL SELECT 'tall', CASE WHEN tall > 0 THEN 'warning' ELSE 'passed' END, {R('tall')} FROM p
  UNION ALL SELECT 'dsm_nodata', CASE WHEN gs > 20 THEN 'warning' WHEN gs > 5 THEN 'note' ELSE 'passed' END, {R('gs')} FROM p
  UNION ALL SELECT 'dtm_nodata', CASE WHEN gt > 20 THEN 'warning' WHEN gt > 5 THEN 'note' ELSE 'passed' END, {R('gt')} FROM p
  UNION ALL SELECT 'completeness', CASE WHEN cp < 80 THEN 'issue' WHEN cp < 95 THEN 'warning' ELSE 'passed' END, {R('cp')} FROM p
  UNION ALL SELECT 'outliers', CASE WHEN op > 5 THEN 'warning' ELSE 'passed' END, {R('op')} FROM o
  UNION ALL SELECT unnest(['dsm_loads', 'dtm_loads', 'crs', 'shape', 'origin', 'pixel_size', 'square', 'resolution']), 'passed', unnest([(SELECT count(v) FROM {{a}}), (SELECT count(v) FROM {{b}}), 0, 0, 0, 0, 0, 1])::DOUBLE)"""


@query(f"WITH {B.grid_sql(10)}, {FINDINGS_SQL.format(a='dsm', b='dtm')} SELECT * FROM found")
def validate_all(spark, d):
    return C.validate_all(_raster(spark, d, "dsm"), _raster(spark, d, "dtm"))


@query(
    f"WITH {B.grid_sql(10).replace(' AS dtm FROM dsm JOIN dtm USING (r, c))', ' AS dtm FROM a JOIN b USING (r, c))').replace('pair AS (SELECT r, c, dsm.v AS dsm, dtm.v', 'a AS (SELECT * FROM dsm WHERE r < (SELECT max(r) - 1 FROM dsm)), b AS (SELECT * FROM dtm WHERE r < (SELECT max(r) - 1 FROM dsm)), pair AS (SELECT r, c, a.v AS dsm, b.v')}, {FINDINGS_SQL.format(a='a', b='b')} "
    "SELECT count(*) FILTER (severity = 'issue') = 0 AS valid, count(*) FILTER (severity = 'issue') AS issues, count(*) FILTER (severity = 'warning') AS warnings FROM found"
)
def align_and_validate(spark, d):
    """The second raster lacks the last two rows."""
    a, b = _raster(spark, d, "dsm"), _raster(spark, d, "dtm")
    b = C.replace(b, px=b.px.filter(F.col("r") < b.height - 2), height=b.height - 2)
    return C.align_and_validate(a, b)[3]


DIFF = f"count(*) AS blocks_compared, {R('avg(x-y)')} AS mean_diff, {R('sqrt(avg((x-y)*(x-y)))')} AS rmse, {R('avg(abs(x-y))')} AS mae, {R('stddev_pop(x-y)')} AS std_diff"


@query(f"""WITH {B.grid_sql(10)}, hh AS (SELECT max(r)+1 AS h FROM dsm), a AS (SELECT CAST(floor(r/4) AS BIGINT) AS r, CAST(floor(c/4) AS BIGINT) AS c, {R('avg(v)')} AS v FROM dsm, hh WHERE r < floor(h/4)*4 GROUP BY 1, 2),
  s AS (SELECT {DIFF} FROM (SELECT a.v AS x, dtm.v AS y FROM a JOIN dtm USING (r, c)) WHERE x - y IS NOT NULL)
  SELECT *, abs(mean_diff) BETWEEN 50 AND 62 AND std_diff < 10 AS is_datum_offset, CASE WHEN abs(mean_diff) < CAST(0.3 AS DOUBLE) AND rmse < CAST(0.5 AS DOUBLE) THEN 'excellent' WHEN abs(mean_diff) < CAST(0.5 AS DOUBLE) AND rmse < 1 THEN 'good' ELSE 'poor' END AS agreement FROM s""")
def coarse_comparison(spark, d):
    return C.coarse_comparison(_raster(spark, d, "dsm"), _raster(spark, d, "dtm", 4.0), 4.0)


@query(f"""WITH {B.grid_sql(10)}, hh AS (SELECT max(r)+1 AS h, CAST(floor((max(r)+1)/4) AS BIGINT) AS n, CAST(floor(CAST(0.25 AS DOUBLE)*(max(r)+1) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS r0, CAST(floor(CAST(0.5 AS DOUBLE)*(max(r)+1) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS hb FROM dsm),
  a AS (SELECT CAST(floor(r/4) AS BIGINT) AS i, CAST(floor((c-8)/4) AS BIGINT) AS j, {R('avg(v)')} AS v FROM dsm, hh WHERE c >= 8 AND r < n*4 GROUP BY 1, 2),
  ti AS (SELECT i, floor(i*(CAST(hb AS DOUBLE)/n)) AS lo, CASE WHEN i = n-1 THEN 1e18 ELSE floor((i+1)*(CAST(hb AS DOUBLE)/n)) END AS hi FROM range(1000000) x(i), hh WHERE i < n),
  b AS (SELECT ti.i, CAST(floor(c/2) AS BIGINT) AS j, avg(v) AS v FROM dtm, hh JOIN ti ON r - r0 >= lo AND r - r0 < hi WHERE r >= r0 AND r < r0 + hb AND c < 12 GROUP BY 1, 2),
  s AS (SELECT {DIFF} FROM (SELECT a.v AS x, b.v AS y FROM a JOIN b USING (i, j)) WHERE x - y IS NOT NULL)
  SELECT *, abs(mean_diff) BETWEEN 50 AND 62 AND std_diff < 10 AS is_datum_offset, CASE WHEN abs(mean_diff) BETWEEN 50 AND 62 AND std_diff < 10 THEN 'datum_offset' WHEN abs(mean_diff) < CAST(0.3 AS DOUBLE) AND rmse < CAST(0.5 AS DOUBLE) THEN 'excellent' WHEN abs(mean_diff) < 2 AND rmse < 3 THEN 'good' ELSE 'poor' END AS agreement FROM s""")
def overlap_comparison(spark, d):
    """Rasters of half a metre and of one, shifted against each other."""
    return C.overlap_comparison(_raster(spark, d, "dsm", 0.5), _raster(spark, d, "dtm", 1.0, 4.0, 0.75 * _height(spark, d)), 2.0)


@query(f"""WITH {B.grid_sql(10)} SELECT 'crs' AS "check", 'passed' AS severity, CAST(0 AS DOUBLE) AS metric UNION ALL SELECT 'a_projected', 'passed', 0 UNION ALL SELECT 'b_projected', 'passed', 0 UNION ALL SELECT 'overlap', 'passed', 37.5
  UNION ALL SELECT 'a_elevation', CASE WHEN avg(v) < 0 OR avg(v) > 500 THEN 'issue' ELSE 'passed' END, {R('avg(v)')} FROM dsm UNION ALL SELECT 'b_elevation', CASE WHEN avg(v) < 0 OR avg(v) > 500 THEN 'issue' ELSE 'passed' END, {R('avg(v)')} FROM dtm
  UNION ALL SELECT 'a_nodata', 'passed', count(v) FROM dsm UNION ALL SELECT 'b_nodata', 'passed', count(v) FROM dtm""")
def debug_comparison(spark, d):
    h = _height(spark, d)
    return C.debug_comparison(_raster(spark, d, "dsm"), _raster(spark, d, "dtm", 1.0, 16.0, 0.75 * h))


@query(f"""WITH {B.grid_sql(10)}, {B.FILES_SQL}, k AS (SELECT 'dsm' AS n, * FROM dsm UNION ALL SELECT 'dtm', * FROM dtm), p AS (SELECT n, 100.0*count(v)/count(*) AS pct FROM k WHERE r % 5 = 0 AND c % 5 = 0 GROUP BY n)
  SELECT concat('file:', file) AS "check", CASE WHEN lang <> 'de' THEN 'passed' ELSE 'issue' END AS severity, CASE WHEN lang <> 'de' THEN CAST(doc_id AS DOUBLE) END AS metric FROM files
  UNION ALL SELECT concat('coverage:', n), CASE WHEN pct < 10 THEN 'issue' WHEN pct < 80 THEN 'warning' ELSE 'passed' END, {R('pct')} FROM p UNION ALL SELECT 'crs', 'passed', 1 UNION ALL SELECT 'resolution', 'warning', 0.25 UNION ALL SELECT 'tiles', 'passed', 25""")
def preflight(spark, d):
    files = B.files(spark, d)
    there = files.filter("lang <> 'de'").select(F.col("file").alias("path"), F.col("doc_id").alias("length"))
    return C.preflight(files.select(F.col("file").alias("path")), there, {"dsm": _raster(spark, d, "dsm"), "dtm": _raster(spark, d, "dtm", 1.25)}, 25, 5)


@query(f"""WITH {B.grid_sql(10)}, x AS (SELECT r, c, CASE WHEN r >= 7 AND c >= 3 AND c < 29 AND (r + c) % 3 <> 0 THEN v END AS v FROM dsm), m AS (SELECT count(*) AS total, count(v) AS n_valid, min(r) FILTER (v IS NOT NULL) AS r_min, max(r) FILTER (v IS NOT NULL) AS r_max, min(c) FILTER (v IS NOT NULL) AS c_min, max(c) FILTER (v IS NOT NULL) AS c_max FROM x),
  p AS (SELECT *, 100.0*n_valid/total AS a, 100.0*n_valid/((r_max-r_min+1)*(c_max-c_min+1)) AS b FROM m)
  SELECT * EXCLUDE (a, b), {R('a')} AS coverage_pct, {R('b')} AS fill_pct, CASE WHEN a < 1 THEN 'empty' WHEN a < 10 THEN 'mostly_empty' WHEN a < 80 THEN 'partial' ELSE 'good' END AS status, CASE WHEN b < 50 THEN 'sparse' WHEN b < 90 THEN 'partial' ELSE 'dense' END AS box_status FROM p""")
def coverage_report(spark, d):
    keep = (F.col("r") >= 7) & F.col("c").between(3, 28) & ((F.col("r") + F.col("c")) % 3 != 0)
    return C.coverage(B.raster(spark, d, 10, "dsm").withColumn("v", F.when(keep, F.col("v"))))


@query(f"""WITH {B.METHODS3_SQL}, ok AS (SELECT r, c FROM m3 GROUP BY r, c HAVING count(v) = 3), k AS (SELECT m3.* FROM m3 JOIN ok USING (r, c)), e AS (SELECT a.method, b.v AS x, a.v AS y FROM k a JOIN k b USING (r, c) WHERE b.method = 'mean' AND a.method <> 'mean')
  SELECT method, count(*) AS n, {R('avg(y-x)')} AS mean_diff, {R('stddev_pop(y-x)')} AS std_diff, {R('sqrt(avg((y-x)*(y-x)))')} AS rmse, {R('max(abs(y-x))')} AS max_abs, {R(CORR)} AS correlation FROM e GROUP BY method""")
def compare_methods(spark, d):
    return C.compare_methods(B.methods3(spark, d), 3, "mean")[1]
