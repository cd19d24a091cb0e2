"""Sums over the points of each interval, without a row for each pair of point and interval.

Where many intervals overlap, their pairs with points grow with the product of
both tables.  Sums need no pairs.  An interval of w positions is cut at the
multiples of the largest power of two that is not above w: it takes the end of
one bin, the beginning of another and at most one whole bin between.  Running
sums inside the bins, from both sides, give these parts.  Nothing is
subtracted, so a sum is that of its own points to the last digits, and values
that are not finite stay where they belong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def interval_sums(points: DataFrame, intervals: DataFrame, names: list[str], key: list[str], by: list[str] | None = None) -> DataFrame:
    """`key`, `by` and the sums `names` of the points in each interval, for those that hold a point.

    `points`: chr, bp, `by`, `names`; `intervals`: `key`, chr, lo, hi (both
    belong to it).  Several intervals of one key add up.  Sums are made for
    each value of `by`.
    """
    by = by or []
    here = intervals.where("hi >= lo").select(*[F.col(k).alias(f"k_{k}") for k in key], "chr", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    here = here.withColumn("level", F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1)
    low, high = F.expr("shiftright(lo, level)"), F.expr("shiftright(hi, level)")
    end = F.struct(F.lit(1).alias("side"), low.alias("bin"), (-F.col("lo")).alias("at"))
    whole = F.struct(F.lit(1).alias("side"), (low + 1).alias("bin"), (-F.expr("shiftleft(shiftright(lo, level) + 1, level)")).alias("at"))
    start = F.struct(F.lit(0).alias("side"), high.alias("bin"), F.col("hi").alias("at"))
    parts = F.array_compact(F.array(end, F.when(high > low, start), F.when(high > low + 1, whole)))
    asked = here.select(*[f"k_{k}" for k in key], "chr", "level", F.explode(parts).alias("e")).select("*", "e.*").drop("e")
    place = points.where(F.col("bp").isNotNull()).groupBy(*by, "chr", F.col("bp").cast("long").alias("bp")).agg(*[F.sum(c).alias(c) for c in names])
    levels = here.select("level").distinct()  # as many as an interval's length has bits
    binned = place.crossJoin(F.broadcast(levels)).withColumn("bin", F.expr("shiftright(bp, level)"))
    cells = binned.select(*by, "chr", "level", "bin").distinct()
    asked = asked.join(cells, ["chr", "level", "bin"])
    none = [F.lit(None).cast(t).alias(f"k_{k}") for k, t in ((k, intervals.schema[k].dataType) for k in key)]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("bp").alias("at")), F.struct(F.lit(1).alias("side"), (-F.col("bp")).alias("at")))).alias("e")
    held = binned.select(*by, "chr", "level", "bin", *names, *none, sides).select("*", "e.*", F.lit(0).alias("asks")).drop("e")
    empty = [F.lit(None).cast(place.schema[c].dataType).alias(c) for c in names]
    rows = held.unionByName(asked.select("*", *empty, F.lit(1).alias("asks")))
    so_far = W.partitionBy(*by, "chr", "level", "bin", "side").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("asks", *by, *[F.col(f"k_{k}").alias(k) for k in key], F.count(F.when(F.col("asks") == 0, 1)).over(so_far).alias("_held"), *[F.sum(c).over(so_far).alias(f"s_{c}") for c in names])
    return summed.where("asks = 1 and _held > 0").groupBy(*key, *by).agg(*[F.sum(f"s_{c}").alias(c) for c in names])


def joined(intervals: DataFrame, key: list[str]) -> DataFrame:
    """key, chr, lo, hi: the intervals of each key as disjoint ones."""
    by = W.partitionBy(*key, "chr").orderBy("lo", "hi")
    far = intervals.where("hi >= lo").select(*key, "chr", "lo", "hi").withColumn("far", F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)))
    cut = far.withColumn("part", F.sum(F.when(F.col("far") >= F.col("lo"), 0).otherwise(1)).over(by))
    return cut.groupBy(*key, "chr", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def layers(intervals: DataFrame, group: str, number: str) -> DataFrame:
    """`group`, chr, lo, hi, alone: the positions of each group's intervals, cut where `alone` changes.

    `alone` is the number of the one interval that lies there, null where
    there are several.  A sweep over starts and ends: the sum of the numbers
    of open intervals is the number of the one that is open alone.
    """
    n = F.col(number).cast("decimal(38,0)")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d"), n.alias("n")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d"), (-n).cast("decimal(38,0)").alias("n")))).alias("e")
    steps = intervals.where("hi >= lo").select(group, "chr", ends).select(group, "chr", "e.*").groupBy(group, "chr", "at").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    by = W.partitionBy(group, "chr").orderBy("at")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    swept = steps.select(group, "chr", "at", F.sum("d").over(upto).alias("depth"), F.sum("n").over(upto).alias("n"), F.lead("at").over(by).alias("next"))
    kind = swept.select(group, "chr", F.col("at").alias("lo"), (F.col("next") - 1).alias("hi"), F.least("depth", F.lit(2)).alias("depth"), F.when(F.col("depth") == 1, F.col("n").cast("long")).alias("alone"))
    order = W.partitionBy(group, "chr").orderBy("lo")
    same = F.lag("depth").over(order).eqNullSafe(F.col("depth")) & F.lag("alone").over(order).eqNullSafe(F.col("alone"))
    run = kind.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return run.where("depth > 0").groupBy(group, "chr", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("alone").alias("alone")).drop("run")


def widened(genes: DataFrame, flank: int, start: str = "gstart", end: str = "gend") -> DataFrame:
    """gene, chr, lo, hi, disjoint for each gene."""
    return joined(genes.select("gene", "chr", (F.col(start).cast("long") - flank).alias("lo"), (F.col(end).cast("long") + flank).alias("hi")), ["gene"])


def one_place(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snp, chr, bp of the variants with one position; the same of those with several)."""
    at = F.struct("chr", "bp")
    ends = places.groupBy("snp").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    one = ends.where("a = b").select("snp", "a.*")
    return one, places.select("snp", "chr", "bp").distinct().join(ends.where("not a <=> b").select("snp"), "snp")
