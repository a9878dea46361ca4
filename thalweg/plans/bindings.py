"""The driver's tables as rasters, water samples, gauges and files; the SQL text beside each is the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import decimate


def px(spark: SparkSession, d: str, per_tile: int = 50) -> DataFrame:
    """Water-candidate samples by three methods."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").filter(F.col("l_returnflag") != "N")
    s = lambda name, rank, depth: F.struct(F.lit(name).alias("method"), F.lit(rank).alias("rank"), depth.alias("depth0"))
    methods = F.array(s("webodm", 0, F.col("l_quantity") / 10 - 0.5), s("bluesky", 1, F.col("l_discount") * 60), s("fusion", 2, F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 80)))
    rows = t.select(F.floor(F.col("l_orderkey") / per_tile).cast("bigint").alias("tile"), (F.col("l_extendedprice") / 1000).alias("surface"), F.explode(methods).alias("m"))
    return rows.select("tile", "surface", "m.method", "m.rank", (F.col("surface") - F.col("m.depth0")).alias("riverbed"))


def px_sql(per_tile: int = 50) -> str:
    return f"""px AS (SELECT tile, surface, method, rnk, surface - depth0 AS riverbed, surface - (surface - depth0) AS depth FROM (
      SELECT CAST(FLOOR(l_orderkey/{per_tile}) AS BIGINT) AS tile, l_extendedprice/1000 AS surface, l_linenumber, l_quantity, l_discount, l_tax,
        unnest(['webodm','bluesky','fusion']) AS method, unnest([0,1,2]) AS rnk,
        unnest([l_quantity/10 - CAST(0.5 AS DOUBLE), l_discount*60, CASE WHEN l_linenumber <> 7 THEN l_tax*80 END]) AS depth0
      FROM lineitem WHERE l_returnflag <> 'N'))"""


def pixels(spark: SparkSession, d: str, k: int) -> DataFrame:
    """grid(k): all 64 columns of the raster (r, pos, v)."""
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("pos", "e"))
    return t.select("r", "pos", F.when((F.col("r") * 7 + F.col("pos")) % 97 != 0, 100 + k * F.col("e").cast("double")).alias("v"))


def raster(spark: SparkSession, d: str, k: int, which: str) -> DataFrame:
    """One of the two co-registered rasters (r, c, v), 32 columns wide."""
    t = pixels(spark, d, k)
    t = t.filter("pos < 32") if which == "dsm" else t.filter("pos >= 32")
    return t.select("r", (F.col("pos") % 32).cast("bigint").alias("c"), "v")


def pair(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(r, c, dsm, dtm) of the two rasters: halves of one row of pixels, so no join."""
    e = F.col("embedding")
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("r"), F.posexplode(F.arrays_zip(F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))).alias("c", "x"))
    of = lambda x, shift: F.when((F.col("r") * 7 + F.col("c") + shift) % 97 != 0, 100 + k * F.col(x).cast("double"))
    return t.select("r", F.col("c").cast("bigint").alias("c"), of("x.a", 0).alias("dsm"), of("x.b", 32).alias("dtm"))


def grid_sql(k: int) -> str:
    return f"""grid AS (SELECT r, pos, CASE WHEN (r*7+pos) % 97 <> 0 THEN 100 + {k}*CAST(e AS DOUBLE) END AS v FROM (
      SELECT vec_id AS r, unnest(embedding) AS e, generate_subscripts(embedding,1)-1 AS pos FROM embeddings)),
    dsm AS (SELECT r, CAST(pos AS BIGINT) AS c, v FROM grid WHERE pos < 32), dtm AS (SELECT r, CAST(pos-32 AS BIGINT) AS c, v FROM grid WHERE pos >= 32),
    pair AS (SELECT r, c, dsm.v AS dsm, dtm.v AS dtm FROM dsm JOIN dtm USING (r, c))"""


def methods3(spark: SparkSession, d: str) -> DataFrame:
    """(method, r, c, v): dsm, dtm and their mean."""
    s = lambda n, v: F.struct(F.lit(n).alias("method"), v.alias("v"))
    m = F.explode(F.array(s("dsm", F.col("dsm")), s("dtm", F.col("dtm")), s("mean", (F.col("dsm") + F.col("dtm")) / 2)))
    return pair(spark, d, 10).select("r", "c", m.alias("m")).select("m.method", "r", "c", "m.v")


METHODS3_SQL = grid_sql(10) + ", m3 AS (SELECT 'dsm' AS method, r, c, dsm AS v FROM pair UNION ALL SELECT 'dtm', r, c, dtm FROM pair UNION ALL SELECT 'mean', r, c, (dsm+dtm)/2 FROM pair)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Image names; those of one language have no mask."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    return t.select("doc_id", "lang", F.concat(F.lit("DJI_2025_"), "lang", F.col("doc_id").cast("string"), F.lit("_V_patch_"), F.lpad((F.col("doc_id") % 400).cast("string"), 4, "0"), F.lit(".jpg")).alias("file"))


FILES_SQL = "files AS (SELECT doc_id, lang, concat('DJI_2025_', lang, CAST(doc_id AS VARCHAR), '_V_patch_', lpad(CAST(doc_id % 400 AS VARCHAR), 4, '0'), '.jpg') AS file FROM documents)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k, g = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    t = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("id"), (k * 10).alias("left"), (k * 10 + 15 + g).alias("right"), (g * 10).alias("bottom"), (F.col("n_nationkey") % 3).alias("m"))
    return t.withColumn("top", F.col("bottom") + 12 + F.col("m") * 5).drop("m")


BOXES_SQL = "boxes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey*10 AS DOUBLE) AS l, CAST(n_nationkey*10+15+n_regionkey AS DOUBLE) AS r, CAST(n_regionkey*10 AS DOUBLE) AS b, CAST(n_regionkey*10+12+(n_nationkey%3)*5 AS DOUBLE) AS t FROM nation)"


def points(spark: SparkSession, d: str, every: int = 1) -> DataFrame:
    """(id, x, y, z): the valid pixels of dsm; with `every`, of dsm on a coarser grid."""
    t = raster(spark, d, 10, "dsm")
    if every > 1:
        t = decimate(t, every).withColumns({"r": F.col("r") * every, "c": F.col("c") * every})
    t = t.filter(F.col("v").isNotNull())
    return t.select((F.col("r") * 32 + F.col("c")).alias("id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.col("v").alias("z"))


POINTS_SQL = grid_sql(10) + ", points AS (SELECT r*32+c AS id, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, v AS z FROM dsm WHERE v IS NOT NULL)"


def gauge_raw(spark: SparkSession, d: str) -> DataFrame:
    """(date, span) a day, as a gauge's file has them; the first day of a month is empty."""
    t = spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.when(F.dayofmonth("day") != 1, F.concat(F.round("lo", 3).cast("string"), F.lit(" - "), F.round("hi", 3).cast("string"))).otherwise("")
    return t.select(F.date_format("day", "dd/MM/yyyy").alias("date"), span.alias("span"))
