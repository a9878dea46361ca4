"""File names and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where a tile number stands in a file name; the first that matches counts.
TILE_PATTERNS = (r"(?i)patch[_-](\d+)", r"(?i)tile[_-](\d+)", r"(?i)_(\d+)\.[a-z]+$")


def tile_number(name: Column) -> Column:
    """P29."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in TILE_PATTERNS]).cast("int")


def has_patch(name: Column, number: Column) -> Column:
    """P30."""
    return F.contains(name, F.format_string("patch_%04d", number))


def parse_work_list(lines: DataFrame) -> DataFrame:
    """Rows (list_id, pos, line) to one row a tile; tiles without an image are dropped."""
    head = F.regexp_extract("line", r"^Tile (\d+):", 1)
    number = F.last(F.nullif(head, F.lit("")).cast("int"), ignorenulls=True).over(W.partitionBy("list_id").orderBy("pos"))
    pick = lambda pattern: F.max(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    rows = lines.withColumn("tile_num", number).filter(F.col("tile_num").isNotNull())
    out = rows.groupBy("list_id", "tile_num").agg(pick(r"^Tile \d+: DSM ([\d.]+)%").cast("double").alias("dsm_pct"), pick(r"DTM ([\d.]+)%$").cast("double").alias("dtm_pct"), pick(r"^\s+Image:\s+(.*)$").alias("image_file"), pick(r"^\s+Mask:\s+(.*)$").alias("mask_file"))
    return out.filter(F.col("image_file").isNotNull())


def work_list_lines(tiles: DataFrame) -> DataFrame:
    """Tiles (tile_num, dsm_pct, dtm_pct, image_file, mask_file) to (tile_num, block) lines of text."""
    return tiles.select("tile_num", F.format_string("Tile %d: DSM %.1f%%, DTM %.1f%%\n  Image: %s\n  Mask:  %s\n", "tile_num", "dsm_pct", "dtm_pct", "image_file", "mask_file").alias("block"))


def basename(path: Column) -> Column:
    """P31."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def renamed(path: Column, mark: str, suffix: str = ".tif") -> Column:
    """The path of a result beside its input: <stem><mark><suffix>."""
    return F.concat(F.regexp_replace(path, r"[^/]*$", ""), stem(path), F.lit(mark + suffix))


def long_form(wide: DataFrame, keys: list[str], methods: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Columns <method>_<measure> as rows (keys, method, measures); methods without columns give none."""
    there = [m for m in methods if any(f"{m}_{x}" in wide.columns for x in measures)]
    if not there:
        raise ValueError(f"no columns of {methods}")
    cell = lambda m, x: F.col(f"{m}_{x}") if f"{m}_{x}" in wide.columns else F.lit(None)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[cell(m, x).alias(x) for x in measures]) for m in there])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def found_methods(columns: list[str], measure: str = "depth_mean") -> list[str]:
    """The methods that have a column of the measure."""
    return [c.removesuffix(f"_{measure}") for c in columns if c.endswith(f"_{measure}")]
