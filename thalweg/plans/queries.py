"""A query for each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import grid as G
from ..functions import names
from ..operators import composites, focal, geostat, joins, stats, validate, vision, warp
from ..sources import files as sources
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def R(x: str, n: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + CAST(1e-11 AS DOUBLE), {n}) + CAST(0 AS DOUBLE)"


# tile depth


def depth_sql(per_tile: int, ceiling: int) -> str:
    ok = f"FILTER (depth > 0 AND depth < {ceiling})"
    return f"""{B.px_sql(per_tile)}, td AS (SELECT tile, method, rnk AS rank, count(*) AS water_pixels, count(*) {ok} AS valid_pixels,
      {R(f'avg(depth) {ok}')} AS depth_mean, {R(f'median(depth) {ok}')} AS depth_median, {R(f'stddev_pop(depth) {ok}')} AS depth_std, {R(f'min(depth) {ok}')} AS depth_min, {R(f'max(depth) {ok}')} AS depth_max,
      {R(f'avg(surface) {ok}')} AS surface_mean, {R(f'stddev_pop(surface) {ok}')} AS surface_std, {R(f'avg(riverbed) {ok}')} AS riverbed_mean, {R(f'stddev_pop(riverbed) {ok}')} AS riverbed_std,
      {R(f'100.0*count(*) {ok}/count(*)')} AS coverage_pct FROM px GROUP BY tile, method, rnk)"""


def _depths(spark: SparkSession, d: str, per_tile: int = 50, ceiling: float = 5.0) -> DataFrame:
    return stats.tile_depth(B.px(spark, d, per_tile), ceiling)


@query(f"WITH {depth_sql(50, 5)} SELECT * FROM td WHERE tile IN (SELECT tile FROM td WHERE valid_pixels > 0)")
def tile_depth_all_methods(spark, d):
    return stats.tiles_with_any(_depths(spark, d))


@query(f"WITH {depth_sql(50, 10)} SELECT * EXCLUDE (method, rank) FROM td WHERE method = 'bluesky' AND valid_pixels > 0")
def tile_depth_single(spark, d):
    return stats.tile_depth(B.px(spark, d).filter("method = 'bluesky'"), 10.0).filter("valid_pixels > 0").drop("method", "rank")


@query(f"""WITH {depth_sql(50, 5)} SELECT count(*) AS successful, CAST(sum(water_pixels) AS BIGINT) AS total_water_pixels, CAST(sum(valid_pixels) AS BIGINT) AS total_valid_depths, {R('avg(depth_mean)')} AS depth_mean,
  {R('median(depth_median)')} AS depth_median, {R('stddev_samp(depth_mean)')} AS std_of_means, {R('avg(depth_std)')} AS mean_of_stds, min(depth_min) AS depth_min, max(depth_max) AS depth_max,
  {R('avg(surface_mean)')} AS surface_mean, {R('avg(riverbed_mean)')} AS riverbed_mean FROM td WHERE method = 'bluesky' AND valid_pixels > 0""")
def run_summary(spark, d):
    return stats.run_summary(_depths(spark, d).filter("method = 'bluesky'"))


@query(f"WITH {depth_sql(5, 5)} SELECT method, CASE WHEN valid_pixels > 0 THEN 'ok' ELSE 'no_valid_depths' END AS status, count(*) AS tiles FROM td GROUP BY ALL")
def status_counts(spark, d):
    status = F.when(F.col("valid_pixels") > 0, "ok").otherwise("no_valid_depths")
    return _depths(spark, d, 5).groupBy("method", status.alias("status")).agg(F.count("*").alias("tiles"))


@query(f"""WITH {depth_sql(50, 5)} SELECT method, count(*) FILTER (valid_pixels > 0) AS tiles_with_data, count(*) AS total_tiles, {R('100.0*count(*) FILTER (valid_pixels > 0)/count(*)')} AS coverage_pct,
  {R('avg(valid_pixels) FILTER (valid_pixels > 0)')} AS mean_valid_pixels, {R('avg(coverage_pct) FILTER (valid_pixels > 0)')} AS mean_coverage_per_tile, {R('avg(depth_mean)')} AS depth_mean, {R('median(depth_median)')} AS depth_median,
  {R('stddev_samp(depth_mean)')} AS depth_std, min(depth_min) AS depth_min, max(depth_max) AS depth_max, {R('avg(riverbed_mean)')} AS riverbed_mean, {R('stddev_samp(riverbed_mean)')} AS riverbed_std FROM td GROUP BY method""")
def method_performance(spark, d):
    return stats.method_performance(_depths(spark, d))


@query(f"WITH {depth_sql(50, 5)}, q AS (SELECT method, quantile_cont(depth_mean, [0, 0.25, 0.5, 0.75, 1]) AS q FROM td GROUP BY method) SELECT method, {R('q[1]')} AS low, {R('q[2]')} AS q1, {R('q[3]')} AS median, {R('q[4]')} AS q3, {R('q[5]')} AS high FROM q")
def box_summary(spark, d):
    q = _depths(spark, d).groupBy("method").agg(F.percentile("depth_mean", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    return q.select("method", *[A.tidy(F.col("q")[i]).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def pairs_sql(both: bool = False) -> str:
    return f"{depth_sql(5, 5)}, good AS (SELECT tile, method, rank, depth_mean AS v FROM td WHERE valid_pixels > 10 AND depth_mean IS NOT NULL), pairs AS (SELECT a.method AS method_1, b.method AS method_2, a.v AS x, b.v AS y, a.tile FROM good a JOIN good b USING (tile) {'' if both else 'WHERE a.rank < b.rank'})"


CORR = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y)/(stddev_pop(x)*stddev_pop(y)) END"


@query(f"""WITH {pairs_sql()} SELECT method_1, method_2, count(*) AS n_tiles, {R(CORR)} AS correlation_r, {R('sqrt(avg((y-x)*(y-x)))')} AS rmse, {R('avg(abs(y-x))')} AS mae, {R('avg(y-x)')} AS bias,
  {R('stddev_pop(y-x)')} AS bias_std, {R('max(abs(y-x))')} AS max_abs_diff FROM pairs GROUP BY 1, 2 HAVING count(*) >= 3""")
def pairwise_stats(spark, d):
    return stats.pair_statistics(stats.method_pairs(_depths(spark, d, 5)))


@query()
def pairwise_pvalues(spark, d):
    return geostat.pair_pvalues(stats.method_pairs(_depths(spark, d, 5)))


@query(f"WITH {pairs_sql(True)} SELECT method_1, method_2, count(*) AS n, {R(CORR)} AS r FROM pairs GROUP BY 1, 2 HAVING count(*) > 2")
def corr_matrix(spark, d):
    return stats.method_pairs(_depths(spark, d, 5), both_orders=True).groupBy("method_1", "method_2").agg(F.count("*").alias("n"), A.tidy(stats.safe_corr("x", "y")).alias("r")).filter("n > 2")


@query(f"WITH {pairs_sql(True)} SELECT method_1, method_2, {R('sqrt(avg((y-x)*(y-x)))')} AS rmse FROM pairs WHERE method_1 <> method_2 GROUP BY 1, 2")
def rmse_matrix(spark, d):
    dd = F.col("y") - F.col("x")
    return stats.method_pairs(_depths(spark, d, 5), both_orders=True).filter("method_1 <> method_2").groupBy("method_1", "method_2").agg(A.tidy(F.sqrt(F.avg(dd * dd))).alias("rmse"))


@query(f"WITH {pairs_sql()} SELECT method_1, method_2, {R('avg((x+y)/2)')} AS mean_level, {R('avg(y-x)')} AS mean_diff, {R('avg(y-x)-CAST(1.96 AS DOUBLE)*stddev_samp(y-x)')} AS lower, {R('avg(y-x)+CAST(1.96 AS DOUBLE)*stddev_samp(y-x)')} AS upper FROM pairs GROUP BY 1, 2")
def bland_altman(spark, d):
    dd = F.col("y") - F.col("x")
    m, s = F.avg(dd), F.stddev_samp(dd)
    return stats.method_pairs(_depths(spark, d, 5)).groupBy("method_1", "method_2").agg(A.tidy(F.avg((F.col("x") + F.col("y")) / 2)).alias("mean_level"), A.tidy(m).alias("mean_diff"), A.tidy(m - 1.96 * s).alias("lower"), A.tidy(m + 1.96 * s).alias("upper"))


@query(f"WITH {pairs_sql()} SELECT count(*) AS n, {R('avg(x-y)')} AS mean_over, {R('stddev_samp(x-y)')} AS std_over FROM pairs WHERE method_1 = 'webodm' AND method_2 = 'bluesky'")
def overestimation(spark, d):
    o = F.col("x") - F.col("y")
    return stats.method_pairs(_depths(spark, d, 5)).filter("method_1 = 'webodm' and method_2 = 'bluesky'").agg(F.count("*").alias("n"), A.tidy(F.avg(o)).alias("mean_over"), A.tidy(F.stddev_samp(o)).alias("std_over"))


@query(f"""WITH {depth_sql(5, 5)}, w AS (SELECT tile, bool_or(valid_pixels > 5) FILTER (method = 'bluesky') AS a, bool_or(valid_pixels > 5) FILTER (method = 'fusion') AS b FROM td GROUP BY tile)
  SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS source_class, count(*) AS tiles FROM w GROUP BY 1""")
def source_availability(spark, d):
    has = lambda m: F.bool_or((F.col("method") == m) & (F.col("valid_pixels") > 5))
    w = _depths(spark, d, 5).groupBy("tile").agg(has("bluesky").alias("a"), has("fusion").alias("b"))
    return w.groupBy(joins.availability(F.col("a"), F.col("b")).alias("source_class")).agg(F.count("*").alias("tiles"))


@query(f"WITH {depth_sql(50, 5)} SELECT tile, method, depth_std FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY depth_std, rank) AS rn FROM td WHERE depth_std IS NOT NULL) WHERE rn = 1")
def best_method(spark, d):
    best = F.min_by(F.struct("method", "depth_std"), F.struct("depth_std", "rank")).alias("b")
    return _depths(spark, d).filter("depth_std is not null").groupBy("tile").agg(best).select("tile", "b.method", "b.depth_std")


@query(f"WITH {depth_sql(50, 5)} SELECT tile, rn FROM (SELECT tile, row_number() OVER (ORDER BY tile) AS rn FROM td WHERE method = 'bluesky' AND valid_pixels > 0) WHERE rn % 10 = 1 OR rn <= 3")
def every_nth(spark, d):
    return stats.every_nth(_depths(spark, d).filter("method = 'bluesky' and valid_pixels > 0"), "tile")


@query(f"WITH {depth_sql(50, 5)} SELECT tile, {R('avg(coverage_pct)')} AS mean_coverage FROM td GROUP BY tile ORDER BY mean_coverage DESC, tile LIMIT 10")
def top_tiles(spark, d):
    return _depths(spark, d).groupBy("tile").agg(A.tidy(F.avg("coverage_pct")).alias("mean_coverage")).orderBy(F.desc("mean_coverage"), "tile").limit(10)


@query(f"WITH {depth_sql(50, 5)} SELECT method, CASE WHEN coverage_pct < 10 THEN 'low' WHEN coverage_pct < 80 THEN 'partial' ELSE 'good' END AS status, count(*) AS tiles FROM td GROUP BY ALL")
def coverage_status(spark, d):
    return _depths(spark, d).groupBy("method", A.coverage_status(F.col("coverage_pct")).alias("status")).agg(F.count("*").alias("tiles"))


# pixel algebra and statistics

ENCODED = B.grid_sql(100) + ", enc AS (SELECT r, c, coalesce(v, -9999) AS raw FROM dsm)"


def _encoded(spark, d):
    return B.raster(spark, d, 100, "dsm").select("r", "c", A.filled(F.col("v")).alias("raw"))


@query(f"WITH {ENCODED} SELECT count(*) AS total, count(*) FILTER (raw <> -9999) AS valid, {R('avg(raw) FILTER (raw <> -9999)')} AS mean FROM enc")
def nodata_mask(spark, d):
    v = A.masked(F.col("raw"))
    return _encoded(spark, d).agg(F.count("*").alias("total"), F.count(v).alias("valid"), A.tidy(F.avg(v)).alias("mean"))


@query(f"WITH {B.grid_sql(100)} SELECT count(v) AS n, {R('min(v)')} AS min_value, {R('max(v)')} AS max_value, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('median(v)')} AS median FROM dsm")
def raster_stats(spark, d):
    return stats.summary(B.raster(spark, d, 100, "dsm"), "v")


@query(f"WITH {ENCODED} SELECT CASE WHEN raw = -9999 THEN 'nodata' WHEN raw < 0 THEN 'negative' WHEN raw > 0 THEN 'positive' ELSE 'zero' END AS kind, count(*) AS n, count(*) FILTER (raw BETWEEN 0 AND 500) AS plausible FROM enc GROUP BY 1")
def pixel_taxonomy(spark, d):
    return _encoded(spark, d).groupBy(A.pixel_kind(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("raw").between(0, 500)).alias("plausible"))


@query(f"WITH {B.grid_sql(10)} SELECT count(DISTINCT v) AS n_distinct, count(DISTINCT CAST(floor(v) AS BIGINT)) AS n_metres FROM dsm")
def distinct_values(spark, d):
    return B.raster(spark, d, 10, "dsm").agg(F.count_distinct("v").alias("n_distinct"), F.count_distinct(F.floor("v")).alias("n_metres"))


@query(f"WITH {B.grid_sql(100)}, n AS (SELECT CASE WHEN dsm - dtm < 0 THEN 0 ELSE dsm - dtm END AS h, dsm - dtm AS raw FROM pair) SELECT count(h) AS n, {R('avg(h)')} AS mean, {R('max(h)')} AS max_height, count(*) FILTER (raw < 0) AS clamped, {R('avg(CASE WHEN h IS NOT NULL THEN least(50, greatest(0, h)) END)')} AS mean_clipped FROM n")
def ndsm(spark, d):
    h = A.ndsm(F.col("dsm"), F.col("dtm"))
    return B.pair(spark, d, 100).agg(F.count(h).alias("n"), A.tidy(F.avg(h)).alias("mean"), A.tidy(F.max(h)).alias("max_height"), F.count_if(F.col("dsm") < F.col("dtm")).alias("clamped"), A.tidy(F.avg(A.clipped(h, 0.0, 50.0))).alias("mean_clipped"))


@query(f"""WITH {B.grid_sql(100)}, f AS (SELECT dsm, dtm, CASE WHEN dsm < dtm THEN dtm ELSE dsm END AS fixed FROM pair), g AS (SELECT *, CASE WHEN dtm IS NULL OR fixed - dtm <= 50 THEN fixed END AS cleaned FROM f)
  SELECT count(*) FILTER (dsm - dtm < CAST(-0.1 AS DOUBLE)) AS violations_before, count(*) FILTER (cleaned - dtm < CAST(-0.1 AS DOUBLE)) AS violations_after, count(*) FILTER (dsm - dtm > 50) AS tall_before, count(*) FILTER (cleaned - dtm > 50) AS tall_after, count(cleaned) AS n, {R('avg(cleaned)')} AS mean FROM g""")
def clean(spark, d):
    return composites.clean(B.raster(spark, d, 100, "dsm"), B.raster(spark, d, 100, "dtm"))[1]


@query(f"""WITH {B.grid_sql(100)}, k AS (SELECT (CASE WHEN h >= 0 THEN 1 ELSE 0 END + CASE WHEN h >= 2 THEN 1 ELSE 0 END + CASE WHEN h >= 5 THEN 1 ELSE 0 END + CASE WHEN h >= 10 THEN 1 ELSE 0 END + CASE WHEN h >= 15 THEN 1 ELSE 0 END + CASE WHEN h >= 100 THEN 1 ELSE 0 END) AS height_class, h FROM (SELECT dsm - dtm AS h FROM pair) WHERE h IS NOT NULL)
  SELECT height_class, count(*) AS n, {R('100.0*count(*)/sum(count(*)) OVER ()')} AS pct, count(*) FILTER (h > CAST(0.5 AS DOUBLE)) AS vegetation FROM k GROUP BY height_class""")
def height_classes(spark, d):
    h = F.col("dsm") - F.col("dtm")
    t = B.pair(spark, d, 100).filter(h.isNotNull())
    total = F.broadcast(t.agg(F.count("*").alias("total")))
    return t.groupBy(A.height_class(h).alias("height_class")).agg(F.count("*").alias("n"), F.count_if(h > 0.5).alias("vegetation")).crossJoin(total).select("height_class", "n", A.tidy(A.share(F.col("n"), F.col("total"))).alias("pct"), "vegetation")


@query(f"""WITH {B.grid_sql(100)}, m AS (SELECT count(*) AS total, count(dsm - dtm) AS n_both, count(dsm) AS n_dsm, count(dtm) AS n_dtm, min(dsm) AS s0, max(dsm) AS s1, min(dtm) AS t0, max(dtm) AS t1, count(*) FILTER (dsm - dtm < CAST(-0.1 AS DOUBLE)) AS bad, count(*) FILTER (dsm - dtm > 50) AS tall FROM pair),
  p AS (SELECT *, 100.0*bad/n_both AS vp, 100.0*n_both/total AS cp, 100.0 - 100.0*n_dsm/total AS gs, 100.0 - 100.0*n_dtm/total AS gt FROM m)
  SELECT 'dsm_range' AS "check", CASE WHEN s0 < -100 OR s1 > 5000 OR s1 - s0 > 1000 THEN 'warning' ELSE 'passed' END AS severity, {R('s1 - s0')} AS metric FROM p
  UNION ALL SELECT 'dtm_range', CASE WHEN t0 < -100 OR t1 > 5000 OR t1 - t0 > 1000 THEN 'warning' ELSE 'passed' END, {R('t1 - t0')} FROM p
  UNION ALL SELECT 'height_logic', CASE WHEN vp > 5 THEN 'issue' WHEN vp > 1 THEN 'warning' ELSE 'passed' END, {R('vp')} FROM p
  UNION ALL SELECT 'tall', CASE WHEN tall > 0 THEN 'warning' ELSE 'passed' END, {R('tall')} FROM p
  UNION ALL SELECT 'dsm_nodata', CASE WHEN gs > 20 THEN 'warning' WHEN gs > 5 THEN 'note' ELSE 'passed' END, {R('gs')} FROM p
  UNION ALL SELECT 'dtm_nodata', CASE WHEN gt > 20 THEN 'warning' WHEN gt > 5 THEN 'note' ELSE 'passed' END, {R('gt')} FROM p
  UNION ALL SELECT 'completeness', CASE WHEN cp < 80 THEN 'issue' WHEN cp < 95 THEN 'warning' ELSE 'passed' END, {R('cp')} FROM p""")
def validate_rasters(spark, d):
    return validate.findings(validate.metrics(B.pair(spark, d, 100)))


@query(f"""WITH {B.grid_sql(100)}, x AS (SELECT power((dsm - dtm)/10, 3) AS v FROM pair), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x)
  SELECT count(v) AS n, count(*) FILTER (v < a - 3*(b-a) OR v > b + 3*(b-a)) AS n_outliers, {R('100.0*count(*) FILTER (v < a - 3*(b-a) OR v > b + 3*(b-a))/count(v)')} AS outlier_pct, {R('any_value(a)')} AS q1, {R('any_value(b)')} AS q3 FROM x, q""")
def iqr_outliers(spark, d):
    return stats.iqr_outliers(B.pair(spark, d, 100).select(F.pow((F.col("dsm") - F.col("dtm")) / 10, F.lit(3.0)).alias("v")), "v")


# The levels that are reported.
PCTS = (0, 1, 5, 25, 50, 75, 95, 99, 100)


@query(f"WITH {B.grid_sql(100)}, q AS (SELECT quantile_cont(v, {[p / 100 for p in PCTS]}) AS q FROM dsm WHERE v IS NOT NULL), u AS (SELECT unnest(q) AS v, unnest({list(PCTS)}) AS pct FROM q) SELECT pct, {R('v')} AS value FROM u")
def percentiles(spark, d):
    return stats.percentiles(B.raster(spark, d, 100, "dsm"), "v", PCTS)


@query(f"WITH {B.grid_sql(100)}, e AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n FROM dsm) SELECT CAST(least(floor((v-lo)/((hi-lo)/30)), 29) AS INTEGER) AS bin, count(*) AS count, {R('CAST(count(*) AS DOUBLE)/any_value(n)/any_value((hi-lo)/30)', 9)} AS density FROM dsm, e WHERE v IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(B.raster(spark, d, 100, "dsm"), "v", 30)


def errors_sql(x: str) -> str:
    return f"count({x}) AS n, {R(f'avg({x})')} AS bias, {R(f'avg(abs({x}))')} AS mae, {R(f'sqrt(avg(({x})*({x})))')} AS rmse, {R(f'stddev_pop({x})')} AS std, {R(f'min({x})')} AS min_diff, {R(f'max({x})')} AS max_diff"


@query(f"WITH {B.grid_sql(10)}, e AS (SELECT {errors_sql('dsm - dtm')} FROM pair) SELECT *, CASE WHEN abs(bias) BETWEEN 50 AND 62 AND std < 10 THEN 'datum_offset' WHEN rmse < CAST(0.5 AS DOUBLE) THEN 'good' WHEN rmse < 2 THEN 'fair' ELSE 'poor' END AS agreement FROM e")
def error_metrics(spark, d):
    e = B.pair(spark, d, 10).agg(*stats.error_metrics(F.col("dsm") - F.col("dtm")))
    return e.withColumn("agreement", A.agreement(F.col("bias"), F.col("rmse"), F.col("std")))


@query(f"WITH {B.METHODS3_SQL}, ok AS (SELECT r, c FROM m3 GROUP BY r, c HAVING count(v) = 3) SELECT method, count(v) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('median(v)')} AS median FROM m3 JOIN ok USING (r, c) GROUP BY method")
def common_pixels(spark, d):
    return stats.summary(joins.common_pixels(B.methods3(spark, d), 3), "v", "method").select("method", "n", "mean", "std", "median")


@query(f"WITH {B.METHODS3_SQL}, x AS (SELECT a.method, a.v - b.v AS e FROM m3 a JOIN m3 b USING (r, c) WHERE b.method = 'mean' AND a.method <> 'mean') SELECT method, {errors_sql('e')} FROM x GROUP BY method")
def vs_reference(spark, d):
    return joins.against_reference(B.methods3(spark, d), "mean").groupBy("method").agg(*stats.error_metrics(F.col("v") - F.col("ref")))


# shapes and grids


@query(f"WITH {B.grid_sql(10)}, a AS (SELECT r, c FROM dsm WHERE c < 30), b AS (SELECT r, c FROM dtm WHERE r >= 2), j AS (SELECT a.r IS NOT NULL AS x, b.r IS NOT NULL AS y FROM a FULL JOIN b USING (r, c)) SELECT count(*) FILTER (x AND y) AS kept, count(*) FILTER (NOT y) AS removed_a, count(*) FILTER (NOT x) AS removed_b FROM j")
def align(spark, d):
    return joins.align_report(B.raster(spark, d, 10, "dsm").filter("c < 30"), B.raster(spark, d, 10, "dtm").filter("r >= 2"))


INNER = "CASE WHEN r >= 7 AND r <= (SELECT max(vec_id) FROM embeddings) - 5 AND c >= 3 AND c < 29 THEN v END"


def _inner(spark, d):
    """The raster with an empty frame."""
    return B.raster(spark, d, 10, "dsm").withColumn("v", F.when(F.col("r").between(7, _height(spark, d) - 6) & F.col("c").between(3, 28), F.col("v")))


@query(f"WITH {B.grid_sql(10)}, i AS (SELECT r, c, {INNER} AS v FROM dsm) SELECT min(r) AS row_min, max(r)+1 AS row_max, min(c) AS col_min, max(c)+1 AS col_max, count(*) AS n_valid FROM i WHERE v IS NOT NULL")
def valid_bbox(spark, d):
    return stats.valid_bbox(_inner(spark, d))


@query(f"WITH {B.grid_sql(10)}, i AS (SELECT r, c, {INNER} AS v FROM dsm), b AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM i WHERE v IS NOT NULL) SELECT count(*) AS n, count(v) AS n_valid, {R('avg(v)')} AS mean FROM dtm, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def crop_to_valid(spark, d):
    return joins.crop_to(B.raster(spark, d, 10, "dtm"), stats.valid_bbox(_inner(spark, d))).agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), A.tidy(F.avg("v")).alias("mean"))


@query(f"WITH {B.grid_sql(10)} SELECT CAST(r/4 AS BIGINT) AS r, CAST(c/4 AS BIGINT) AS c, {R('v')} AS v FROM dsm WHERE r % 4 = 0 AND c % 4 = 0")
def decimate(spark, d):
    return stats.decimate(B.raster(spark, d, 10, "dsm"), 4).select("r", "c", A.tidy(F.col("v")).alias("v"))


@query(f"WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm) SELECT CAST(floor(r/7) AS BIGINT) AS block_row, CAST(floor(c/7) AS BIGINT) AS block_col, {R('avg(v)')} AS mean, count(v) AS n FROM dsm, h WHERE r < floor(h/7)*7 AND c < 28 GROUP BY 1, 2")
def block_mean(spark, d):
    return stats.block_mean(B.raster(spark, d, 10, "dsm"), _height(spark, d), 32, 7)


def _height(spark, d) -> int:
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT CAST(max(r)+1 AS DOUBLE)/37 AS s FROM dsm), t AS (SELECT i, floor(i*s) AS a, CASE WHEN i = 36 THEN 1e18 ELSE floor((i+1)*s) END AS b FROM range(37) x(i), h)
  SELECT CAST(i AS BIGINT) AS target_row, c, {R('avg(v)')} AS mean, count(*) AS n FROM dsm JOIN t ON r >= a AND r < b GROUP BY 1, 2""")
def proportional_blocks(spark, d):
    return stats.proportional_blocks(B.raster(spark, d, 10, "dsm"), _height(spark, d), 37)


@query(f"WITH {B.grid_sql(10)} SELECT c, {R('v')} AS v FROM dsm WHERE r = (SELECT CAST(floor((max(r)+1)/2) AS BIGINT) FROM dsm)")
def transect(spark, d):
    return B.raster(spark, d, 10, "dsm").filter(F.col("r") == _height(spark, d) // 2).select("c", A.tidy(F.col("v")).alias("v"))


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT CAST(floor((max(r)+1-16)/12)+1 AS BIGINT) AS n FROM dsm), t AS (SELECT i AS tile_number, CAST(floor(i/2) AS BIGINT) AS grid_row, i % 2 AS grid_col FROM range(1000000) x(i), h WHERE i < 2*n)
  SELECT *, grid_row*12 AS pixel_row, grid_col*12 AS pixel_col, CAST(grid_col*12 AS DOUBLE)*2 AS bounds_left, 0-CAST(grid_row*12 AS DOUBLE)*2 AS bounds_top, CAST(grid_col*12+16 AS DOUBLE)*2 AS bounds_right, -CAST(grid_row*12+16 AS DOUBLE)*2 AS bounds_bottom FROM t""")
def tile_grid(spark, d):
    """Of the table's raster."""
    return G.tile_grid(spark, 32, _height(spark, d), 16, 12, (2.0, 0.0, 0.0, 0.0, -2.0, 0.0))


TILES = "h AS (SELECT CAST(floor((max(r)+1-16)/12)+1 AS BIGINT) AS n FROM dsm), tl AS (SELECT x.i AS tr, y.j AS tc FROM range(100000) x(i), range(2) y(j), h WHERE x.i < n), a AS (SELECT tr*2+tc AS tile, r, c, v FROM dsm JOIN tl ON r >= tr*12 AND r < tr*12+16 AND c >= tc*12 AND c < tc*12+16)"


def _assigned(spark, d, which="dsm"):
    rows, cols = G.grid_size(32, _height(spark, d), 16, 12)
    return joins.assign_tiles(B.raster(spark, d, 10, which), rows, cols, 16, 12)


@query(f"WITH {B.grid_sql(10)}, {TILES} SELECT tile, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM a GROUP BY tile")
def tile_assignment(spark, d):
    return _assigned(spark, d).groupBy("tile").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


@query(f"WITH {B.grid_sql(10)}, {TILES} SELECT tile, {R('100.0*count(v)/count(*)')} AS pct, CASE WHEN 100.0*count(v)/count(*) < 10 THEN 'low' WHEN 100.0*count(v)/count(*) < 80 THEN 'partial' ELSE 'good' END AS status FROM a GROUP BY tile HAVING count(v) >= 1")
def tile_coverage(spark, d):
    pct = A.share(F.col("n_valid"), F.col("n"))
    t = _assigned(spark, d).groupBy("tile").agg(F.count("*").alias("n"), F.count("v").alias("n_valid")).filter("n_valid >= 1")
    return t.select("tile", A.tidy(pct).alias("pct"), A.coverage_status(pct).alias("status"))


@query(f"WITH {B.FILES_SQL}, t AS (SELECT DISTINCT doc_id % 400 AS tile, lang = (SELECT min(lang) FROM files) AS bare FROM files), n AS (SELECT (CAST(floor(tile/20) AS BIGINT)+i)*20 + tile%20+j AS tile FROM t, range(-2, 3) x(i), range(-2, 3) y(j) WHERE bare) SELECT tile FROM n WHERE tile BETWEEN 0 AND 399 UNION SELECT tile FROM t WHERE NOT bare")
def candidate_tiles(spark, d):
    """Tiles around the images of one language, and all tiles of the others."""
    t = B.files(spark, d).select(names.tile_number(F.col("file")).cast("bigint").alias("tile"), "lang")
    bare = F.col("lang") == F.col("first")
    t = t.crossJoin(F.broadcast(t.agg(F.min("lang").alias("first")))).select("tile", bare.alias("bare")).distinct()
    return joins.candidate_tiles(t.filter("bare").select("tile"), t.filter("not bare").select("tile"), 20, 20, 2)


@query(f"""WITH {B.grid_sql(10)}, w AS (SELECT CAST(floor(r/50) AS BIGINT) AS tile, r, c, coalesce(dsm > 100, FALSE) AS water, dsm - dtm AS depth FROM pair), k AS (SELECT tile, r, count(*) FILTER (depth > 0 AND depth < 5) AS ok, max(c)-min(c)+1 AS width FROM w WHERE water GROUP BY tile, r)
  SELECT tile, count(*) AS n_rows, {R('avg(width)')} AS mean_width, {R('max(width)')} AS max_width FROM k WHERE ok > 0 GROUP BY tile HAVING count(*) > 10""")
def river_width(spark, d):
    t = B.pair(spark, d, 10).select(F.floor(F.col("r") / 50).alias("tile"), "r", "c", F.coalesce(F.col("dsm") > 100, F.lit(False)).alias("water"), (F.col("dsm") - F.col("dtm")).alias("depth"))
    return stats.river_width(t, 5.0)


# focal




@query(f"""WITH {B.grid_sql(10)}, m AS (SELECT avg(v) AS m, max(r)+1 AS h FROM dsm), f AS (SELECT r, c, coalesce(v, m) AS v FROM dsm, m), kk AS (SELECT i AS k, exp(-CAST(i*i AS DOUBLE)/8) AS w FROM range(-8, 9) x(i)), kn AS (SELECT k, w/(SELECT sum(w) FROM kk) AS w FROM kk),
  s AS (SELECT r, c, w, CASE WHEN r+k < 0 THEN -1-(r+k) WHEN r+k >= h THEN 2*h-1-(r+k) ELSE r+k END AS q FROM dsm, kn, m) SELECT s.r, s.c, {R('sum(w*f.v)')} AS v FROM s JOIN f ON f.r = s.q AND f.c = s.c GROUP BY s.r, s.c""")
def gaussian_1d(spark, d):
    t = B.raster(spark, d, 10, "dsm")
    full = t.crossJoin(F.broadcast(t.agg(F.avg("v").alias("m")))).select("r", "c", F.coalesce("v", "m").alias("v"))
    return focal.smooth_along(full, "r", _height(spark, d), focal.gaussian_kernel(2.0), 32).select("r", "c", A.tidy(F.col("v")).alias("v"))


@query(f"""WITH {B.grid_sql(10)}, t AS (SELECT i AS t, i*(CAST(31 AS DOUBLE)/79) AS p FROM range(80) x(i)), q AS (SELECT t, CAST(least(floor(p), 30) AS BIGINT) AS lo, p FROM t)
  SELECT a.r, q.t AS c, {R('CASE WHEN p - lo >= 1 THEN b.v WHEN p > lo THEN a.v*(1-(p-lo)) + b.v*(p-lo) ELSE a.v END')} AS v FROM q JOIN dsm a ON a.c = lo JOIN dsm b ON b.c = lo+1 AND b.r = a.r""")
def resize_bilinear(spark, d):
    return focal.resize_linear(B.raster(spark, d, 10, "dsm"), "c", 32, 80).select("r", "c", A.tidy(F.col("v")).alias("v"))


@query(f"""WITH {B.grid_sql(10)} SELECT a.r, a.c, {R('(n.v - s.v)/2')} AS dzdr, {R('(e.v - w.v)/2')} AS dzdc FROM dsm a JOIN dsm n ON n.r = a.r+1 AND n.c = a.c JOIN dsm s ON s.r = a.r-1 AND s.c = a.c JOIN dsm e ON e.r = a.r AND e.c = a.c+1 JOIN dsm w ON w.r = a.r AND w.c = a.c-1""")
def hillshade_gradient(spark, d):
    return focal.gradients(B.raster(spark, d, 10, "dsm"), _height(spark, d), 32).select("r", "c", A.tidy(F.col("dzdr")).alias("dzdr"), A.tidy(F.col("dzdc")).alias("dzdc"))


@query(f"""WITH {B.grid_sql(10)}, h AS (SELECT max(r)+1 AS h FROM dsm), b AS (SELECT i, greatest(0, i*32-4) AS lo, least(h, (i+1)*32+4) AS hi FROM range(100000) x(i), h WHERE i*32 < h),
  w AS (SELECT r, c, v*(1 + i) AS v, least(CAST(1 AS DOUBLE), (least(r-lo, hi-1-r)+1)/CAST(5 AS DOUBLE)) AS w FROM dsm JOIN b ON r >= lo AND r < hi WHERE v IS NOT NULL) SELECT r, c, {R('sum(w*v)/sum(w)')} AS v, count(*) AS n_blocks FROM w GROUP BY r, c""")
def taper_blend(spark, d):
    """Each block holds its own values, so that the blend shows."""
    parts = focal.halo_blocks(B.raster(spark, d, 10, "dsm"), "r", _height(spark, d), 32, 4).withColumn("v", F.col("v") * (1 + F.col("block")))
    return focal.taper_blend(parts, "r", 4).select("r", "c", A.tidy(F.col("v")).alias("v"), "n_blocks")


# geostatistics, vision, warp

CENTRES = "SELECT i AS block, CAST(16 AS DOUBLE) AS cx, CAST(i*32+16 AS DOUBLE) AS cy FROM range(100000) x(i) WHERE i*32 <= (SELECT max(vec_id) FROM embeddings)"


def _centres(spark, d):
    """Blocks of 32 rows over the whole raster."""
    return spark.range(-(-_height(spark, d) // 32)).select(F.col("id").alias("block"), F.lit(16.0).alias("cx"), (F.col("id") * 32 + 16).cast("double").alias("cy"))


NEAR = B.POINTS_SQL + f", centres AS ({CENTRES}), near AS (SELECT block, id, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS dist FROM centres JOIN points ON y BETWEEN cy-24 AND cy+24 WHERE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) <= 24)"


@query(f"WITH {NEAR} SELECT block, count(*) AS n, {R('avg(dist)')} AS mean_dist, {R('max(dist)')} AS max_dist FROM near GROUP BY block")
def radius_neighbours(spark, d):
    return joins.neighbours(_centres(spark, d), B.points(spark, d), 24.0).groupBy("block").agg(F.count("*").alias("n"), A.tidy(F.avg("dist")).alias("mean_dist"), A.tidy(F.max("dist")).alias("max_dist"))


@query(f"WITH {NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY dist, id) AS rank FROM near) SELECT block, id, rank, {R('dist')} AS dist FROM k WHERE rank <= 12")
def knn(spark, d):
    return joins.nearest(joins.neighbours(_centres(spark, d), B.points(spark, d), 24.0), 12).select("block", "id", F.col("rank").cast("bigint").alias("rank"), A.tidy(F.col("dist")).alias("dist"))


@query(f"WITH {B.POINTS_SQL}, s AS (SELECT count(*) AS n, (max(x)-min(x))*(max(y)-min(y)) AS area FROM points) SELECT n, area, {R('n/area')} AS density, {R('sqrt(area/n)')} AS spacing, {R('CASE WHEN 15 < 3*sqrt(area/n) THEN 5*sqrt(area/n) ELSE 15 END')} AS radius FROM s")
def point_density(spark, d):
    return geostat.point_density(B.points(spark, d)).select("n", "area", A.tidy(F.col("density")).alias("density"), A.tidy(F.col("spacing")).alias("spacing"), A.tidy(F.col("radius")).alias("radius"))


@query(f"""WITH {B.POINTS_SQL}, p AS (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS h, CAST(0.5 AS DOUBLE)*(a.z-b.z)*(a.z-b.z) AS g FROM points a JOIN range(8) k(dy) ON TRUE JOIN points b ON b.y = a.y + k.dy AND (b.y > a.y OR b.x > a.x))
  SELECT CAST(floor(h/CAST(0.5 AS DOUBLE)) AS INTEGER) AS lag_bin, {R('avg(h)')} AS lag, {R('avg(g)')} AS semivariance, count(*) AS n_pairs FROM p WHERE h > 0 AND h < 8 GROUP BY 1""")
def variogram(spark, d):
    return geostat.variogram_within(B.points(spark, d), 16, 8.0).select("lag_bin", A.tidy(F.col("lag")).alias("lag"), A.tidy(F.col("semivariance")).alias("semivariance"), "n_pairs")


@query()
def krige_block(spark, d):
    """Every block of the raster, from the raster on a grid four times coarser."""
    points = B.points(spark, d, 4)
    model = geostat.fit_variogram(points)
    blocks = _centres(spark, d).select("block", "cx", "cy", F.lit(0.0).alias("x0"), (F.col("cy") - 16).alias("y0"), F.lit(32).alias("w"), F.least(F.lit(32), F.lit(_height(spark, d)) - F.col("cy") + 16).cast("int").alias("h"), F.lit(1.0).alias("step"))
    out = geostat.krige_blocks(blocks, points, model, 24.0)
    return out.select("block", "x", "y", F.round("prediction", 6).alias("prediction"), F.round("variance", 6).alias("variance"), "n_points")


@query(f"""WITH {B.grid_sql(10)}, t AS (SELECT r-200 AS tr, c-10 AS tc, v AS t FROM dsm WHERE r BETWEEN 200 AND 207 AND c BETWEEN 10 AND 17), h AS (SELECT max(r)+1 AS h FROM dsm), s AS (SELECT d.r-tr AS dr, d.c-tc AS dc, count(*) AS n, covar_pop(t, v)/(stddev_pop(t)*stddev_pop(v)) AS score FROM dsm d, t, h WHERE d.r-tr BETWEEN 0 AND h-8 AND d.c-tc BETWEEN 0 AND 24 AND t IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)
  SELECT dr, dc, {R('score')} AS score, score >= CAST(0.7 AS DOUBLE) AS confident FROM s ORDER BY s.score DESC, dr, dc LIMIT 1""")
def template_match(spark, d):
    image = B.raster(spark, d, 10, "dsm")
    template = image.filter(F.col("r").between(200, 207) & F.col("c").between(10, 17)).select((F.col("r") - 200).alias("r"), (F.col("c") - 10).alias("c"), "v")
    best = vision.best_match(vision.match_scores(template, image, _height(spark, d), 32, 8, 8))
    return best.select("dr", "dc", A.tidy(F.col("score")).alias("score"), "confident")


@query()
def tm_roundtrip(spark, d):
    """The raster's points as places in Ireland, to UTM, to the old Irish grid with its datum, and back."""
    t = B.points(spark, d).select("id", (530000 + F.col("x") * 1500).alias("x"), (550000 + F.col("y") % 100 * 3000).alias("y"))
    steps = ("EPSG:2157", "EPSG:32629", "EPSG:29903", "EPSG:2157")
    at = [(F.col("x"), F.col("y"))]
    for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False)):
        x, y = warp.transform(*at[-1], a, b)
        t = t.withColumns({f"x{i}": x, f"y{i}": y})
        at.append((F.col(f"x{i}"), F.col(f"y{i}")))
    return t.select("id", *[F.round(c, 3).alias(n) for c, n in (("x0", "utm_x"), ("y0", "utm_y"), ("x1", "grid_x"), ("y1", "grid_y"))], (F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) < 0.01).alias("closes"))


@query(f"WITH {B.BOXES_SQL} SELECT a.id AS id_a, b.id AS id_b, greatest(a.l, b.l) AS \"left\", least(a.r, b.r) AS \"right\", greatest(a.b, b.b) AS bottom, least(a.t, b.t) AS top, (least(a.r, b.r)-greatest(a.l, b.l))*(least(a.t, b.t)-greatest(a.b, b.b)) AS area FROM boxes a JOIN boxes b ON a.id < b.id AND a.l < b.r AND b.l < a.r AND a.b < b.t AND b.b < a.t")
def bbox_overlap(spark, d):
    return joins.bbox_overlap(B.boxes(spark, d), 20.0)


@query(f"WITH {B.grid_sql(10)}, m AS (SELECT CAST(floor(r/100) AS BIGINT) AS file_rank, r % 100 AS r, c, v FROM dsm WHERE v IS NOT NULL) SELECT r, c, {R('arg_min(v, file_rank)')} AS v, min(file_rank) AS file_rank FROM m GROUP BY r, c")
def mosaic_first(spark, d):
    t = B.raster(spark, d, 10, "dsm").select(F.floor(F.col("r") / 100).alias("file_rank"), (F.col("r") % 100).alias("r"), "c", "v")
    return joins.mosaic_first(t).select("r", "c", A.tidy(F.col("v")).alias("v"), "file_rank")


# names, lists, gauges

TILE_NUM = "CAST(coalesce(nullif(regexp_extract(file, '(?i)patch[_-](\\d+)', 1), ''), nullif(regexp_extract(file, '(?i)tile[_-](\\d+)', 1), ''), nullif(regexp_extract(file, '(?i)_(\\d+)\\.[a-z]+$', 1), '')) AS INTEGER)"


def _named(spark, d):
    return B.files(spark, d).select("doc_id", "lang", "file", names.tile_number(F.col("file")).alias("tile_num"))


@query(f"WITH {B.FILES_SQL} SELECT doc_id, file, {TILE_NUM} AS tile_num FROM files")
def tile_number_regex(spark, d):
    return _named(spark, d).drop("lang")


@query(f"WITH {B.FILES_SQL}, n AS (SELECT doc_id, lang, file, {TILE_NUM} AS tile_num FROM files), a AS (SELECT tile_num, max(file) AS image, count(*) AS n_image FROM n GROUP BY 1), b AS (SELECT tile_num, max(file) AS mask, count(*) AS n_mask FROM n WHERE lang <> 'de' GROUP BY 1) SELECT * FROM a JOIN b USING (tile_num)")
def image_mask_pairs(spark, d):
    n = _named(spark, d)
    return joins.file_pairs(n, n.filter("lang <> 'de'"))


@query(f"WITH {B.FILES_SQL}, n AS (SELECT lang, {TILE_NUM} AS tile_num FROM files) SELECT DISTINCT tile_num FROM n WHERE tile_num NOT IN (SELECT tile_num FROM n WHERE lang <> 'de')")
def missing_files(spark, d):
    n = _named(spark, d)
    return joins.missing(n.select("tile_num").distinct(), n.filter("lang <> 'de'").select("tile_num").distinct(), "tile_num")


@query("SELECT CAST(doc_id AS INTEGER) AS tile_num, round(CAST(doc_id % 101 AS DOUBLE), 1) AS dsm_pct, round(CAST(doc_id % 97 AS DOUBLE), 1) AS dtm_pct, concat('img_', lang, '.jpg') AS image_file, concat('mask_', source, '.png') AS mask_file FROM documents WHERE lang <> 'de'")
def parse_work_list(spark, d):
    """Lists of tiles written as text and parsed again; those of one language have no image and go."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("int").alias("tile_num"), (F.col("doc_id") % 101).cast("double").alias("dsm_pct"), (F.col("doc_id") % 97).cast("double").alias("dtm_pct"), F.concat(F.lit("img_"), "lang", F.lit(".jpg")).alias("image_file"), F.concat(F.lit("mask_"), "source", F.lit(".png")).alias("mask_file"))
    blocks = names.work_list_lines(t).withColumn("block", F.regexp_replace("block", r"(?m)^  Image: img_de\.jpg$", ""))
    lines = blocks.select(F.floor(F.col("tile_num") / 50).alias("list_id"), F.posexplode(F.split("block", "\n")).alias("i", "line"), "tile_num")
    return names.parse_work_list(lines.select("list_id", (F.col("tile_num") * 10 + F.col("i")).alias("pos"), "line")).drop("list_id")


@query("WITH g AS (SELECT CAST(ts AS DATE) AS day, round(min(value), 3) AS lo, round(max(value), 3) AS hi FROM events GROUP BY 1) SELECT day AS date, CASE WHEN day(day) <> 1 THEN lo END AS level_min, CASE WHEN day(day) <> 1 THEN hi END AS level_max, CASE WHEN day(day) <> 1 THEN " + R("(lo+hi)/2") + " END AS midpoint FROM g")
def gauge_daily(spark, d):
    g = sources.gauge_rows(B.gauge_raw(spark, d))
    return g.withColumn("midpoint", A.tidy((F.col("level_min") + F.col("level_max")) / 2))


@query("SELECT least(3000, count(*)) AS n, TRUE AS inside FROM lineitem")
def sample_cardinality(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(*keys)
    s = t.orderBy(F.xxhash64(*keys, F.lit(42)), *keys).limit(3000)
    # every sampled row is one of the table
    return s.join(t.distinct().withColumn("there", F.lit(True)), keys, "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("inside"))
