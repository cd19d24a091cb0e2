"""Data behind the standard figures: quantile-quantile, stratified, density and power tables.

Plotting is left to the reader; these frames are what is plotted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Width of a bin of -log10 p.
STEP = 0.1


def qq_data(df: DataFrame, p: str = "p", by: list[str] | None = None, step: float = STEP) -> DataFrame:
    """Observed and expected -log10 p by bins of the observed one.

    A point is a bin: n tests in it, n_at_least at or above it, expected =
    -log10(n_at_least / n).  Only bins are ranked, so no task sees all tests.
    """
    by = by or []
    logp = F.round(F.floor(F.round(-F.log10(F.col(p)) / step, 9)) * step, 6)
    tests = df.where((F.col(p) > 0) & (F.col(p) <= 1)).select(*by, logp.alias("observed"))
    bins = tests.groupBy(*by, "observed").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    down = part.orderBy(F.desc("observed"))
    out = bins.withColumn("n_at_least", F.sum("n").over(down)).withColumn("total", F.sum("n").over(part))
    return out.withColumn("expected", F.round(-F.log10(F.col("n_at_least") / F.col("total")), 6)).drop("total")


def stratified_qq(df: DataFrame, p: str, other_p: str, thresholds: tuple[float, ...] = (1.0, 0.1, 0.01, 0.001)) -> DataFrame:
    """The same for the tests whose p in another trait is at or below each threshold (a test counts in each stratum it meets)."""
    strata = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(other_p) <= t)
    return qq_data(df.select(F.col(p).alias("p"), F.explode(strata).alias("stratum")), "p", ["stratum"])


def density_grid(df: DataFrame, x: str, y: str, lo: float = -5.0, hi: float = 5.0, bins: int = 20) -> DataFrame:
    """Counts on a two-dimensional grid: ix, iy, n, share.  Values outside go to the outer cells."""
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / ((hi - lo) / bins)))).cast("int")
    held = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("ix"), cell(y).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return held.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))  # at most bins x bins rows


def power_curve(df: DataFrame, pi: str = "pi", sig2_beta: str = "sig2_beta", sizes: tuple[float, ...] = (1e4, 3e4, 1e5, 3e5, 1e6, 3e6), z: float = 5.451310) -> DataFrame:
    """Expected share of heritability in variants beyond the genome-wide threshold, by sample size.

    Under effects N(0, sig2_beta), z has variance 1 + N sig2_beta; the share
    is E[b^2; |z| > t] / E[b^2], which has a closed form in the normal tail.
    """
    s2 = 1.0 + F.col("size") * F.col(sig2_beta)
    a = F.lit(z) / F.sqrt(s2)
    tail = 2.0 * _upper(a)
    shrink = (s2 - 1.0) / s2
    share = tail + shrink * 2.0 * a * F.exp(-a * a / 2.0) / F.lit(2.5066282746310002)
    return df.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("share", share)


def _upper(x):
    """Upper tail of the standard normal for x >= 0 (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = 1.0 / (1.0 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2.0) / F.lit(2.5066282746310002) * series
