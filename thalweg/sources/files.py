"""ASCII grids, listings, images, work lists, gauges and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..schema import TILE_DEPTH


#: Lines of an ASCII grid that are no cells.
_HEADER = r"(?i)^(ncols|nrows|xll\w+|yll\w+|cellsize|nodata_value)\s+(\S+)"


def _ascii_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, split by byte ranges: path, where the range starts, place within the range, line."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    return lines.filter("line <> ''")


def ascii_header(spark: SparkSession, path: str) -> DataFrame:
    """Name, columns, rows, corner, cell and nodata of ESRI ASCII grids."""
    lines = _ascii_lines(spark, path).filter(F.col("line").rlike(_HEADER))
    lines = lines.select("path", F.lower(F.regexp_extract("line", _HEADER, 1)).alias("key"), F.regexp_extract("line", _HEADER, 2).alias("value"))
    pick = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    # a grid is placed by its lower left corner or by the centre of the cell there
    corner = lambda axis: F.coalesce(pick(f"{axis}llcorner").cast("double"), pick(f"{axis}llcenter").cast("double") - pick("cellsize").cast("double") / 2)
    return lines.groupBy("path").agg(
        pick("ncols").cast("int").alias("width"),
        pick("nrows").cast("int").alias("height"),
        corner("x").alias("left"),
        corner("y").alias("bottom"),
        pick("cellsize").cast("double").alias("cell"),
        F.coalesce(pick("nodata_value"), F.lit("-9999")).cast("double").alias("nodata"),
    )


def ascii_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, x, y, v) of every cell; nodata is null and y is a cell's centre.

    Files are split by byte ranges. A value's place in its grid is its place in
    the range after the values of the ranges before, so a grid of any size takes
    many tasks, and its lines may be broken anywhere. A window holds one range.
    """
    lines = _ascii_lines(spark, path).filter(~F.col("line").rlike(_HEADER))
    lines = lines.withColumn("s", F.split("line", r"\s+")).withColumn("n", F.size("s"))
    in_order = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    ranges = lines.groupBy("path", "split").agg(F.sum("n").alias("n")).select("path", "split", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    within = W.partitionBy("path", "split").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ranges, ["path", "split"])
    cells = placed.select("path", (F.col("before") + F.col("within")).alias("first"), F.posexplode("s").alias("pos", "s")).select("path", (F.col("first") + F.col("pos")).alias("i"), "s")
    out = cells.join(F.broadcast(ascii_header(spark, path)), "path")  # a row a file
    v, r, c = F.col("s").cast("double"), F.expr("cast(i div width as int)"), (F.col("i") % F.col("width")).cast("int")
    out = out.withColumn("r", r).withColumn("c", c)
    return out.select("path", "r", "c", (F.col("left") + (F.col("c") + 0.5) * F.col("cell")).alias("x"), (F.col("bottom") + (F.col("height") - F.col("r") - 0.5) * F.col("cell")).alias("y"), F.when(v != F.col("nodata"), v).alias("v"))


def write_ascii(px: DataFrame, path: str, transform: tuple, width: int, height: int, rows: int = 1024, nodata: float = -9999.0) -> None:
    """Pixels (r, c, v) as ESRI ASCII grids, one for each `rows` rows: path/grid=<k>/part-*.

    A grid's lines are put together where it is written: a line is one row of
    pixels, and Spark deals whole grids.
    """
    a, _, left, _, _, top = transform
    cell = F.coalesce(F.col("v").cast("string"), F.lit(f"{nodata:g}"))
    lines = px.withColumn("v", cell).groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x.v), " ").alias("value"))
    lines = lines.select(F.expr(f"r div {rows}").alias("grid"), F.col("r").alias("line"), "value")
    n = F.least(F.lit(rows), F.lit(height) - F.col("grid") * rows)
    head = F.concat(F.lit(f"ncols {width}\nnrows "), n.cast("string"), F.lit(f"\nxllcorner {left!r}\nyllcorner "), (F.lit(float(top)) - (F.col("grid") * rows + n) * float(a)).cast("string"), F.lit(f"\ncellsize {float(a)!r}\nNODATA_value {nodata:g}"))
    heads = px.sparkSession.range(-(-height // rows)).select(F.col("id").alias("grid"), F.lit(-1).cast("bigint").alias("line")).withColumn("value", head)
    lines.unionByName(heads).repartition("grid").sortWithinPartitions("grid", "line").select("grid", "value").write.partitionBy("grid").text(path)


def projection(spark: SparkSession, path: str, assumed: str = "EPSG:2157") -> DataFrame:
    """The system a .prj names by its code or a known name; or its definition, which warp.system() reads; or the assumed one."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    code = F.nullif(F.regexp_extract("value", r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]\s*\]\s*$', 1), F.lit(""))
    named = F.when(F.contains(F.upper("value"), F.lit("UTM")) & F.contains("value", F.lit("29")), "EPSG:32629").when(F.contains(F.upper("value"), F.lit("ITM")) | F.contains("value", F.lit("IRENET95")), "EPSG:2157")
    whole = F.when(F.col("value").rlike(r"(?i)^\s*(PROJCS|GEOGCS)\s*\["), F.trim("value"))
    return text.select("path", F.coalesce(F.concat(F.lit("EPSG:"), code), named, whole, F.lit(assumed)).alias("crs"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files once each, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").distinct()


def probe(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Which files of a manifest (path) exist, and their sizes."""
    return manifest.join(files, "path", "left").select("path", F.col("length").isNotNull().alias("present"), "length")


def masks(spark: SparkSession, folder: str, threshold: int = 127) -> DataFrame:
    """Water pixels (path, tile_number, r, c) of gray mask images."""
    img = spark.read.format("image").load(folder).select("image.*").filter("nChannels = 1")
    px = img.select(F.col("origin").alias("path"), "width", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int"))).alias("pos", "v"))
    return px.filter(F.col("v") > threshold).select("path", names.tile_number(F.element_at(F.split("path", "/"), -1)).alias("tile_number"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("r"), (F.col("pos") % F.col("width")).cast("int").alias("c"))


def rgb_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, r, c, red, green, blue); the source's order is blue, green, red."""
    img = spark.read.format("image").load(folder).select("image.*").filter("nChannels = 3")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    px = img.withColumn("i", at)
    return px.select(F.col("origin").alias("path"), F.floor(F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).cast("int").alias("c"), byte(F.col("i") * 3 + 3).alias("red"), byte(F.col("i") * 3 + 2).alias("green"), byte(F.col("i") * 3 + 1).alias("blue"))


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("list_id"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return names.parse_work_list(text)


def work_list_size(spark: SparkSession, path: str) -> int:
    """S12."""
    return spark.read.text(path).filter(F.startswith(F.col("value"), F.lit("Tile"))).count()


def gauge(spark: SparkSession, path: str) -> DataFrame:
    """(date, level_min, level_max); the header's # does not start a comment."""
    raw = spark.read.csv(path, header=True, schema="date string, span string")
    return gauge_rows(raw)


def gauge_rows(raw: DataFrame) -> DataFrame:
    """Rows (date dd/MM/yyyy, span 'lo - hi') parsed; an empty span has no levels."""
    part = lambda i: F.nullif(F.regexp_extract("span", r"^\s*(\S+) - (\S+)\s*$", i), F.lit("")).cast("double")
    return raw.select(F.to_date("date", "dd/MM/yyyy").alias("date"), part(1).alias("level_min"), part(2).alias("level_max"))


def write_tiles(rows: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """CSV with a header, or JSON lines; a folder for each method where rows have one."""
    out = rows.write.mode(mode)
    if "method" in rows.columns:
        out = out.partitionBy("method")
    {"csv": lambda: out.option("header", True).csv(path), "json": lambda: out.json(path)}[kind]()


def summary_json(run: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """K7: one JSON document of a run's row, with a nested map of its methods (a row each)."""
    if methods is None:
        return run.select(F.to_json(F.struct("*")).alias("value"))
    nested = methods.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.struct(*[c for c in methods.columns if c != "method"]))))).alias("methods"))
    return run.crossJoin(nested).select(F.to_json(F.struct("*")).alias("value"))


def tile_rows(spark: SparkSession, path: str, schema: str = TILE_DEPTH) -> DataFrame:
    """Tile rows of a CSV with a header, typed by the schema; the method of write_tiles() comes from the folder."""
    return spark.read.csv(path, header=True, schema=schema)


def json_array(rows: DataFrame) -> DataFrame:
    """K6: a report's rows as one JSON array."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("value"))


def sections(tables: dict[str, DataFrame]) -> DataFrame:
    """K8: tables of a report under each other as lines of CSV, each under a `# heading` and its columns' names."""
    lines = None
    for i, (heading, table) in enumerate(tables.items()):
        spark = table.sparkSession
        top = spark.createDataFrame([(i, 0, f"# {heading}"), (i, 1, ",".join(table.columns))], "section int, kind int, value string")
        part = top.unionByName(table.select(F.lit(i).alias("section"), F.lit(2).alias("kind"), F.to_csv(F.struct("*")).alias("value")))
        lines = part if lines is None else lines.unionByName(part)
    return lines.orderBy("section", "kind", "value").select("value")


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report's ordered lines as one file."""
    lines.coalesce(1).write.mode(mode).text(path)


def work_list_text(tiles: DataFrame) -> DataFrame:
    """The work list's lines, headings first, in the order of tile numbers."""
    head = tiles.sparkSession.createDataFrame([(-1, "Working tiles"), (0, "")], "at bigint, value string")
    blocks = names.work_list_lines(tiles).select((F.col("tile_num") + 1).cast("bigint").alias("at"), F.col("block").alias("value"))
    return head.unionByName(blocks).orderBy("at").select("value")


def report(performance: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A line of text for each method; with pairs, both under headings, each pair with its significance."""
    line = F.format_string("%s: %d of %d tiles, mean depth %.3f m", "method", "tiles_with_data", "total_tiles", "depth_mean")
    methods = performance.select(F.lit(1).alias("section"), F.col("method").alias("key"), line.alias("value"))
    if pairs is None:
        return methods.orderBy("key").select("value")
    headings = performance.sparkSession.createDataFrame([(0, "", "METHODS"), (2, "", "PAIRS")], "section int, key string, value string")
    line = F.format_string("%s - %s: bias %.3f m, RMSE %.3f m, %s", "method_1", "method_2", "bias", "rmse", F.coalesce("significance", F.lit("not tested")))
    both = pairs.select(F.lit(3).alias("section"), F.concat_ws(" ", "method_1", "method_2").alias("key"), line.alias("value"))
    return headings.unionByName(methods).unionByName(both).orderBy("section", "key").select("value")
