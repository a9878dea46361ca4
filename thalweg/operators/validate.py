"""Validators (V1-V16): one aggregate over co-registered pixels, then rules on its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import share, tidy


def metrics(pair: DataFrame, dsm: str = "dsm", dtm: str = "dtm") -> DataFrame:
    """What V3, V4, V6 and V8 need of pixels (dsm, dtm), in one pass."""
    a, b = F.col(dsm), F.col(dtm)
    d = a - b
    both = a.isNotNull() & b.isNotNull()
    return pair.agg(
        F.count("*").alias("total"),
        F.count_if(both).alias("n_both"),
        F.count(a).alias("n_dsm"),
        F.count(b).alias("n_dtm"),
        F.min(a).alias("dsm_min"),
        F.max(a).alias("dsm_max"),
        F.min(b).alias("dtm_min"),
        F.max(b).alias("dtm_max"),
        F.count_if(d < -0.1).alias("n_violations"),
        F.count_if(d > 50).alias("n_tall"),
    )


def findings(m: DataFrame) -> DataFrame:
    """Rows (check, severity, metric) from metrics(); thresholds as R22 states them."""
    pct = lambda n, of: share(F.col(n), F.col(of))
    violations, complete = pct("n_violations", "n_both"), pct("n_both", "total")
    gaps = [F.lit(100.0) - pct(n, "total") for n in ("n_dsm", "n_dtm")]
    ranged = lambda lo, hi: F.when((F.col(lo) < -100) | (F.col(hi) > 5000) | (F.col(hi) - F.col(lo) > 1000), "warning").otherwise("passed")

    def rule(name: str, severity: Column, metric: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), severity.alias("severity"), tidy(metric.cast("double")).alias("metric"))

    rules = [
        rule("dsm_range", ranged("dsm_min", "dsm_max"), F.col("dsm_max") - F.col("dsm_min")),
        rule("dtm_range", ranged("dtm_min", "dtm_max"), F.col("dtm_max") - F.col("dtm_min")),
        rule("height_logic", F.when(violations > 5, "issue").when(violations > 1, "warning").otherwise("passed"), violations),
        rule("tall", F.when(F.col("n_tall") > 0, "warning").otherwise("passed"), F.col("n_tall")),
        *[rule(n, F.when(g > 20, "warning").when(g > 5, "note").otherwise("passed"), g) for n, g in zip(("dsm_nodata", "dtm_nodata"), gaps, strict=True)],
        rule("completeness", F.when(complete < 80, "issue").when(complete < 95, "warning").otherwise("passed"), complete),
    ]
    return m.select(F.explode(F.array(*rules)).alias("f")).select("f.*")


def outlier_finding(outliers: DataFrame, name: str) -> DataFrame:
    """V7 of a row of iqr_outliers()."""
    return outliers.select(F.lit(name).alias("check"), F.when(F.col("outlier_pct") > 5, "warning").otherwise("passed").alias("severity"), F.col("outlier_pct").alias("metric"))


def meta_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """V1, V2 and V5 of two raster_meta rows."""
    x, y = (m.select(F.struct("*").alias(n)) for m, n in ((a, "a"), (b, "b")))
    both = x.crossJoin(F.broadcast(y))  # one row each
    size = F.greatest(F.abs(F.col("a.width") - F.col("b.width")), F.abs(F.col("a.height") - F.col("b.height")))
    origin = F.hypot(F.col("a.transform.c") - F.col("b.transform.c"), F.col("a.transform.f") - F.col("b.transform.f"))
    step = F.abs(F.col("a.transform.a") - F.col("b.transform.a"))
    square = F.abs(F.abs(F.col("a.transform.a")) - F.abs(F.col("a.transform.e")))
    resolution = F.abs(F.col("a.transform.a"))
    rule = lambda n, s, m: F.struct(F.lit(n).alias("check"), s.alias("severity"), m.cast("double").alias("metric"))
    rules = [
        rule("crs", F.when(F.col("a.crs") == F.col("b.crs"), "passed").otherwise("issue"), F.lit(0)),
        rule("shape", F.when(size == 0, "passed").when(size <= 2, "warning").otherwise("issue"), size),
        rule("origin", F.when(origin <= 1, "passed").otherwise("issue"), origin),
        rule("pixel_size", F.when(step <= 0.01, "passed").otherwise("issue"), step),
        rule("square", F.when(square <= 0.001, "passed").otherwise("warning"), square),
        rule("resolution", F.when(resolution.between(0.001, 1.0), "passed").otherwise("warning"), resolution),
    ]
    return both.select(F.explode(F.array(*rules)).alias("f")).select("f.*")


def passes(rows: DataFrame) -> DataFrame:
    """V9: valid if there is no issue."""
    return rows.agg((F.count_if(F.col("severity") == "issue") == 0).alias("valid"), F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"))
