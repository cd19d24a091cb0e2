"""Seeded z-scores with known truth, for tests: unique, shared or partly shared effects of two traits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def two_traits(spark: SparkSession, variants: int, n: float, pi1: float, pi2: float, shared: float, h2: float = 0.5, rho: float = 0.0, seed: int = 1) -> DataFrame:
    """snp, chr, bp, part ("none", "first", "second", "both"), z1, z2, n.

    `shared` is the share of the smaller trait's causal variants that are
    causal in both; effects are normal, their correlation there is `rho`.
    """
    both = shared * min(pi1, pi2)
    u = F.rand(seed)
    part = F.when(u < both, "both").when(u < pi1, "first").when(u < pi1 + pi2 - both, "second").otherwise("none")
    df = spark.range(variants).select(F.concat(F.lit("rs"), "id").alias("snp"), (F.col("id") % 22 + 1).cast("int").alias("chr"), (F.col("id") * 1000).alias("bp"), part.alias("part"))
    a, b, e1, e2 = (F.randn(seed + i) for i in range(1, 5))
    first, second = F.col("part").isin("first", "both"), F.col("part").isin("second", "both")
    size = lambda pi: (h2 / max(variants * pi, 1e-9)) ** 0.5 * n**0.5
    df = df.withColumns({"_a": a, "_b": b})
    z1 = F.when(first, F.col("_a") * size(pi1)).otherwise(0.0) + e1
    z2 = F.when(second, (F.when(F.col("part") == "both", rho * F.col("_a") + (1 - rho**2) ** 0.5 * F.col("_b")).otherwise(F.col("_b"))) * size(pi2)).otherwise(0.0) + e2
    return df.withColumns({"z1": z1, "z2": z2, "n": F.lit(float(n))}).drop("_a", "_b")
