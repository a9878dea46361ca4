"""Aggregates over pixels, tiles and methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from ..functions.algebra import physical, share, tidy


def tile_depth(px: DataFrame, ceiling: float = 5.0) -> DataFrame:
    """A1-A3 by tile and method, over water samples (tile, method, rank, surface, riverbed). Standard deviations are of the population."""
    px = px.withColumn("depth", F.col("surface") - F.col("riverbed"))
    ok = physical(F.col("depth"), ceiling)
    of = lambda c: F.when(ok, F.col(c))
    return (
        px.groupBy("tile", "method", "rank")
        .agg(
            F.count("*").alias("water_pixels"),
            F.count_if(ok).alias("valid_pixels"),
            tidy(F.avg(of("depth"))).alias("depth_mean"),
            tidy(F.median(of("depth"))).alias("depth_median"),
            tidy(F.stddev_pop(of("depth"))).alias("depth_std"),
            tidy(F.min(of("depth"))).alias("depth_min"),
            tidy(F.max(of("depth"))).alias("depth_max"),
            tidy(F.avg(of("surface"))).alias("surface_mean"),
            tidy(F.stddev_pop(of("surface"))).alias("surface_std"),
            tidy(F.avg(of("riverbed"))).alias("riverbed_mean"),
            tidy(F.stddev_pop(of("riverbed"))).alias("riverbed_std"),
        )
        .withColumn("coverage_pct", tidy(share(F.col("valid_pixels"), F.col("water_pixels"))))
    )


def tiles_with_any(depths: DataFrame) -> DataFrame:
    """A tile stays if any method is valid on it."""
    return depths.withColumn("_any", F.max("valid_pixels").over(W.partitionBy("tile"))).filter("_any > 0").drop("_any")


def run_summary(depths: DataFrame) -> DataFrame:
    """A21, with both meanings of depth_std."""
    ok = depths.filter("valid_pixels > 0")
    return ok.agg(
        F.count("*").alias("successful"),
        F.sum("water_pixels").alias("total_water_pixels"),
        F.sum("valid_pixels").alias("total_valid_depths"),
        tidy(F.avg("depth_mean")).alias("depth_mean"),
        tidy(F.median("depth_median")).alias("depth_median"),
        tidy(F.stddev_samp("depth_mean")).alias("std_of_means"),
        tidy(F.avg("depth_std")).alias("mean_of_stds"),
        F.min("depth_min").alias("depth_min"),
        F.max("depth_max").alias("depth_max"),
        tidy(F.avg("surface_mean")).alias("surface_mean"),
        tidy(F.avg("riverbed_mean")).alias("riverbed_mean"),
    )


def method_performance(depths: DataFrame) -> DataFrame:
    """Mean of means, median of medians, sample deviation (R2)."""
    some = F.col("valid_pixels") > 0
    of = lambda c: F.when(some, F.col(c))
    return depths.groupBy("method").agg(
        F.count_if(some).alias("tiles_with_data"),
        F.count("*").alias("total_tiles"),
        tidy(share(F.count_if(some), F.count("*"))).alias("coverage_pct"),
        tidy(F.avg(of("valid_pixels"))).alias("mean_valid_pixels"),
        tidy(F.avg(of("coverage_pct"))).alias("mean_coverage_per_tile"),
        tidy(F.avg(of("depth_mean"))).alias("depth_mean"),
        tidy(F.median(of("depth_median"))).alias("depth_median"),
        tidy(F.stddev_samp(of("depth_mean"))).alias("depth_std"),
        F.min(of("depth_min")).alias("depth_min"),
        F.max(of("depth_max")).alias("depth_max"),
        tidy(F.avg(of("riverbed_mean"))).alias("riverbed_mean"),
        tidy(F.stddev_samp(of("riverbed_mean"))).alias("riverbed_std"),
    )


def method_pairs(depths: DataFrame, least: int = 10, both_orders: bool = False) -> DataFrame:
    """Tile means of two methods side by side, on tiles where both have more than `least` samples."""
    good = depths.filter((F.col("valid_pixels") > least) & F.col("depth_mean").isNotNull())
    a = good.select("tile", F.col("method").alias("method_1"), F.col("rank").alias("rank_1"), F.col("depth_mean").alias("x"))
    b = good.select("tile", F.col("method").alias("method_2"), F.col("rank").alias("rank_2"), F.col("depth_mean").alias("y"))
    return a.join(b, "tile").filter(F.lit(True) if both_orders else F.col("rank_1") < F.col("rank_2"))


def safe_corr(x: str, y: str) -> Column:
    """A12; null where a side does not vary."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """A14 without p-values; differences are second minus first."""
    d = F.col("y") - F.col("x")
    return (
        pairs.groupBy("method_1", "method_2")
        .agg(F.count("*").alias("n_tiles"), tidy(safe_corr("x", "y")).alias("correlation_r"), tidy(F.sqrt(F.avg(d * d))).alias("rmse"), tidy(F.avg(F.abs(d))).alias("mae"), tidy(F.avg(d)).alias("bias"), tidy(F.stddev_pop(d)).alias("bias_std"), tidy(F.max(F.abs(d))).alias("max_abs_diff"))
        .filter("n_tiles >= 3")
    )


def error_metrics(d: Column) -> list[Column]:
    """A11 of a difference."""
    return [F.count(d).alias("n"), tidy(F.avg(d)).alias("bias"), tidy(F.avg(F.abs(d))).alias("mae"), tidy(F.sqrt(F.avg(d * d))).alias("rmse"), tidy(F.stddev_pop(d)).alias("std"), tidy(F.min(d)).alias("min_diff"), tidy(F.max(d)).alias("max_diff")]


def summary(df: DataFrame, v: str, by: str | None = None) -> DataFrame:
    """A4: one row, or one for each class of `by`; medians by quantiles()."""
    c = F.col(v)
    medians = {k: x for k, (_, (x,)) in quantiles(df, v, (0.5,), by).items()}
    median = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col(by).eqNullSafe(F.lit(k)) if by else F.lit(True), F.lit(x)) for k, x in medians.items()])
    rows = (df.groupBy(by) if by else df).agg(F.count(c).alias("n"), tidy(F.min(c)).alias("min_value"), tidy(F.max(c)).alias("max_value"), tidy(F.avg(c)).alias("mean"), tidy(F.stddev_pop(c)).alias("std"))
    return rows.withColumn("median", tidy(median))


#: Intervals that a round of selection cuts a range into, values that a task may hold of one, and classes that are selected for together.
CELLS, HELD, CLASSES = 1024, 20_000, 64


def _ranks(shares: tuple[float, ...], n: int) -> list[tuple[int, int, float]]:
    """For each share the two places (from 0) between which the quantile lies, and how far."""
    out = []
    for q in shares:
        at = q * (n - 1)
        low = int(math.floor(at))
        out.append((low, min(low + 1, n - 1), at - low))
    return out


def quantiles(df: DataFrame, v: str, shares: tuple[float, ...], by: str | None = None) -> dict:
    """A5: {class: (n, [value of each share])}, exact and linear; without `by` the class is None.

    Selection in rounds: values are counted in CELLS equal intervals, those that
    hold a wanted place are cut again between their least and largest value,
    until an interval has HELD values at most (which are then sorted) or one
    value repeated. The driver sees counts of intervals and the few values
    wanted; no task holds more than HELD values of an interval. `by` is for few
    classes (methods, rasters), CLASSES at most. Null and NaN don't count;
    infinite values raise.
    """
    value = F.col(v).cast("double")
    kind = F.col(by) if by else F.lit(None).cast("string")
    rows = df.select(kind.alias("kind"), value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    first = rows.groupBy("kind").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).limit(CLASSES + 1).collect()
    if len(first) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes of {by}: aggregate by group instead")
    if any(math.isinf(r["low"]) or math.isinf(r["high"]) for r in first):
        raise ValueError(f"infinite values of {v}")
    wanted = {r["kind"]: _ranks(shares, r["n"]) for r in first}
    found: dict = {}  # (class, place) -> value
    # class, least and largest value, how many values are below, how many within
    spans = [(r["kind"], r["low"], r["high"], 0, r["n"]) for r in first]

    def places(span: tuple) -> list[int]:
        return sorted({p for low, high, _ in wanted[span[0]] for p in (low, high) if span[3] <= p < span[3] + span[4] and (span[0], p) not in found})

    while spans:
        wide, narrow = [], []
        for s in spans:
            if s[1] == s[2]:
                found |= {(s[0], p): s[1] for p in places(s)}
            elif places(s):
                (wide if s[4] > HELD and s[2] - s[1] > 1e-300 else narrow).append(s)
        inside = lambda some: F.coalesce(*[F.when(F.col("kind").eqNullSafe(F.lit(s[0])) & F.col("v").between(s[1], s[2]), F.lit(i)) for i, s in enumerate(some)])
        if narrow:
            cut = rows.withColumn("span", inside(narrow)).filter("span is not null").groupBy("span").agg(F.sort_array(F.collect_list("v")).alias("x"))
            picks = F.array(*[F.array(*[F.lit(p - s[3]) for p in places(s)]) for s in narrow])
            for r in cut.select("span", F.transform(F.element_at(picks, F.col("span") + 1), lambda i: F.get("x", i)).alias("x")).collect():
                s = narrow[r["span"]]
                found |= {(s[0], p): x for p, x in zip(places(s), r["x"], strict=True)}
        spans = []
        if wide:
            # halves, so that no difference is infinite
            lows, steps = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ([s[1] / 2 for s in wide], [s[2] / CELLS / 2 - s[1] / CELLS / 2 for s in wide]))
            at = F.floor((F.col("v") / 2 - F.element_at(lows, F.col("span") + 1)) / F.element_at(steps, F.col("span") + 1))
            cells = rows.withColumn("span", inside(wide)).filter("span is not null").groupBy("span", F.least(at, F.lit(CELLS - 1)).alias("cell")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for i, s in enumerate(wide):
                below = s[3]
                for r in sorted((r for r in cells if r["span"] == i), key=lambda r: r["cell"]):
                    t = (s[0], r["low"], r["high"], below, r["n"])
                    below += r["n"]
                    if places(t):
                        spans.append(t)
    out = {}
    for r in first:
        x = [found[r["kind"], low] + (found[r["kind"], high] - found[r["kind"], low]) * part for low, high, part in wanted[r["kind"]]]
        out[r["kind"]] = (r["n"], x)
    return out


def percentiles(df: DataFrame, v: str, pcts: tuple[int, ...]) -> DataFrame:
    """A5, exact and linear: a row for each percentile."""
    _, values = quantiles(df, v, tuple(p / 100 for p in pcts)).get(None, (0, [None] * len(pcts)))
    return df.sparkSession.createDataFrame(list(zip(pcts, values, strict=True)), "pct int, value double").select("pct", tidy(F.col("value")).alias("value"))


def iqr_outliers(df: DataFrame, v: str, k: float = 3.0) -> DataFrame:
    """The quartiles by selection, then one pass with them."""
    _, (q1, q3) = quantiles(df, v, (0.25, 0.75)).get(None, (0, (None, None)))
    low, high = F.lit(q1).cast("double"), F.lit(q3).cast("double")
    out = (F.col(v) < low - k * (high - low)) | (F.col(v) > high + k * (high - low))
    return df.agg(F.count(v).alias("n"), F.count_if(out).alias("n_outliers"), tidy(share(F.count_if(out), F.count(v))).alias("outlier_pct"), tidy(F.first(low)).alias("q1"), tidy(F.first(high)).alias("q3"))


def histogram(df: DataFrame, v: str, bins: int) -> DataFrame:
    """Equal widths, the last bin closed; density as well."""
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(v) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(v).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"), tidy(F.count("*") / F.first("n") / F.first(width), 9).alias("density"))


def block_mean(px: DataFrame, height: int, width: int, k: int) -> DataFrame:
    """K x k means; partial blocks at the edges are dropped."""
    keep = px.filter((F.col("r") < height // k * k) & (F.col("c") < width // k * k))
    return keep.groupBy(F.floor(F.col("r") / k).alias("block_row"), F.floor(F.col("c") / k).alias("block_col")).agg(tidy(F.avg("v")).alias("mean"), F.count("v").alias("n"))


def proportional_index(x: Column, size: int, target: int) -> Column:
    """Source x of `size` belongs to the last of `target` places whose int(i * scale) is not above it."""
    scale = size / target
    i = F.floor(x / scale)
    i = F.when(F.floor((i + 1) * F.lit(scale)) <= x, i + 1).otherwise(i)
    i = F.when(F.floor(i * F.lit(scale)) > x, i - 1).otherwise(i)
    return F.least(i, F.lit(target - 1)).cast("bigint")


def proportional_blocks(px: DataFrame, height: int, target: int) -> DataFrame:
    """A8 along rows."""
    return px.groupBy(proportional_index(F.col("r"), height, target).alias("target_row"), "c").agg(tidy(F.avg("v")).alias("mean"), F.count("*").alias("n"))


def valid_bbox(px: DataFrame) -> DataFrame:
    """A10: bounds of the valid pixels, the upper ones open."""
    return px.filter(F.col("v").isNotNull()).agg(F.min("r").alias("row_min"), (F.max("r") + 1).alias("row_max"), F.min("c").alias("col_min"), (F.max("c") + 1).alias("col_max"), F.count("*").alias("n_valid"))


def river_width(px: DataFrame, ceiling: float, pixel: float = 1.0, least_rows: int = 10) -> DataFrame:
    """Extent of all water of each row with a valid pixel; tiles with more than least_rows such rows."""
    rows = px.filter("water").groupBy("tile", "r").agg(F.count_if(physical(F.col("depth"), ceiling)).alias("ok"), ((F.max("c") - F.min("c") + 1) * pixel).alias("width")).filter("ok > 0")
    return rows.groupBy("tile").agg(F.count("*").alias("n_rows"), tidy(F.avg("width")).alias("mean_width"), tidy(F.max("width").cast("double")).alias("max_width")).filter(F.col("n_rows") > least_rows)


def decimate(px: DataFrame, k: int) -> DataFrame:
    """Every k-th pixel."""
    return px.filter((F.col("r") % k == 0) & (F.col("c") % k == 0)).select(F.floor(F.col("r") / k).cast("bigint").alias("r"), F.floor(F.col("c") / k).cast("bigint").alias("c"), "v")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """rn, the place of each row in the order of a key (ties in any order, null first), without one task that holds all rows.

    Rows are dealt in ranges of the key that hold about as many rows each (Spark
    samples them; rows of one key are told apart by their place in the input, so
    that a key with many rows is spread too), numbered in each and offset by the
    rows of the ranges before, of which there are as many as shuffle partitions.
    """
    tie = "_tie"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(F.col(key).asc_nulls_first(), tie).sortWithinPartitions(F.col(key).asc_nulls_first(), tie)
    # worked out once: the ranges of a sample may fall otherwise a second time
    dealt = shared.written(dealt.drop(tie).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("rn", own + F.col("_before")).drop("_part", "_id", "_before")


def every_nth(df: DataFrame, key: str, n: int = 10, first: int = 3) -> DataFrame:
    """Every n-th row in the order of key, and the first few."""
    return numbered(df.select(key), key).filter((F.col("rn") % n == 1) | (F.col("rn") <= first))
