"""Map algebra on pixel columns (P1-P10, P38, F3, F8, F9, F12). Missing is always null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0
NUDGE = 1e-11


def masked(v: Column, nodata: float | None = NODATA) -> Column:
    """Nodata and NaN become null."""
    ok = ~F.isnan(v) if nodata is None else ~F.isnan(v) & (v != nodata)
    return F.when(ok, v)


def filled(v: Column, nodata: float = NODATA) -> Column:
    """Null becomes nodata, for export."""
    return F.coalesce(v, F.lit(nodata))


def clamp_negative(v: Column) -> Column:
    """P5."""
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


def clipped(v: Column, low: float, high: float) -> Column:
    """P6; greatest and least skip nulls, hence the guard."""
    return F.when(v.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), v)))


def ndsm(dsm: Column, dtm: Column) -> Column:
    """Height above ground, not negative."""
    return clamp_negative(dsm - dtm)


def shifted(v: Column, offset: float = 58.0) -> Column:
    """Vertical datum."""
    return v + F.lit(offset)


def canopy_weight(height: Column, scale: float = 2.0) -> Column:
    """P8."""
    return F.exp(-height / scale)


def fused(dtm: Column, detail: Column, alpha: Column) -> Column:
    """P9."""
    return dtm + alpha * detail


def physical(depth: Column, ceiling: float = 5.0) -> Column:
    """An open interval."""
    return (depth > 0) & (depth < ceiling)


def repaired(dsm: Column, dtm: Column) -> Column:
    """A surface below its terrain is lifted to it."""
    return F.when(dsm < dtm, dtm).otherwise(dsm)


def share(part: Column, whole: Column) -> Column:
    """P21, in per cent; null over nothing."""
    return F.try_divide(F.lit(100.0) * part, whole)


def height_class(v: Column, edges: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0, 15.0, 100.0)) -> Column:
    """The number of edges at or below v."""
    out = F.lit(0)
    for e in edges:
        out = out + (v >= e).cast("int")
    return out


def pixel_kind(v: Column, nodata: float = NODATA) -> Column:
    """F12."""
    return F.when(v.isNull() | F.isnan(v), "nan").when(v == nodata, "nodata").when(v < 0, "negative").when(v > 0, "positive").otherwise("zero")


#: Upper bounds of the status tiers by coverage, in per cent; the last tier has none.
READY_TIERS = (("unusable", 10.0), ("sparse", 80.0), ("good", None))
KRIGED_TIERS = (("empty", 1.0), ("mostly_empty", 10.0), ("partial", 80.0), ("good", None))
OVERLAP_TIERS = (("very_low", 10.0), ("low", 50.0), ("moderate", 95.0), ("full", None))
BOX_TIERS = (("sparse", 50.0), ("partial", 90.0), ("dense", None))


def coverage_tier(pct: Column, tiers: tuple) -> Column:
    """P23; nothing at all is in the lowest tier."""
    out = F.when(pct.isNull(), tiers[0][0])
    for name, below in tiers[:-1]:
        out = out.when(pct < below, name)
    return out.otherwise(tiers[-1][0])


def significance(p: Column, level: float = 0.05) -> Column:
    """P26."""
    return F.when(p < level, "significant").when(p.isNotNull(), "not significant")


def band(mean: Column, std: Column, k: float = 1.96) -> tuple[Column, Column]:
    """Mean - k std and mean + k std."""
    return mean - k * std, mean + k * std


def stamp(t: Column | None = None) -> Column:
    """P35."""
    return F.date_format(F.current_timestamp() if t is None else t, "yyyy-MM-dd HH:mm:ss")


def zero_missing(v: Column) -> Column:
    """F6, for rasters that mark missing as 0."""
    return F.nullif(v, F.lit(0.0))


def implausible_mean(mean: Column, low: float = 0.0, high: float = 500.0) -> Column:
    """F16."""
    return (mean < low) | (mean > high)


def coverage_status(pct: Column, low: float = 10.0, high: float = 80.0) -> Column:
    """P23."""
    return F.when(pct < low, "low").when(pct < high, "partial").otherwise("good")


def agreement(bias: Column, rmse: Column, std: Column, good: float = 0.5, fair: float = 2.0) -> Column:
    """P25, with the datum test on a steady offset of 50 to 62 m."""
    return F.when(F.abs(bias).between(50, 62) & (std < 10), "datum_offset").when(rmse < good, "good").when(rmse < fair, "fair").otherwise("poor")


def tidy(v: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero; what lies exactly between two round values goes up, whatever the order of a sum made of it."""
    return F.round(v + F.lit(NUDGE), digits) + F.lit(0.0)
