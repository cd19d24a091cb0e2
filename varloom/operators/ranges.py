"""Genomic ranges: their grammar, exclusion, and interval and window joins.

A range predicate alone would plan as a nested loop over all pairs, and
equality on the chromosome alone leaves 22 uneven keys.  Positions are
therefore put into bins: an interval is repeated for each bin it touches, a
position has one bin, and the join is an equi-join on (chromosome, bin) with
the exact condition on top.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The preset of the range grammar (25-35 Mb), which is wider than the strict window of harmonisation.
MHC = ("6", 25_000_000, 35_000_000)
_UNIT = {"": 1, "B": 1, "KB": 1_000, "MB": 1_000_000}


def parse_range(text: str) -> tuple[str, int, int]:
    """One range: "MHC", "chr21:20-21MB", "chr22:19100-19900KB", "6:25000000-35000000".  Both ends belong to it."""
    t = text.strip()
    if t.upper() == "MHC":
        return MHC
    m = re.fullmatch(r"(?:chr)?(\w+):(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\s*([KM]?B)?", t, re.I)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    unit = _UNIT[(m[4] or "").upper()]
    lo, hi = round(float(m[2]) * unit), round(float(m[3]) * unit)
    if lo > hi:
        raise ValueError(f"range ends before it begins: {text!r}")
    return m[1].upper().removeprefix("CHR"), lo, hi


def parse_ranges(texts: str | list[str]) -> list[tuple[str, int, int]]:
    """A list or a blank- or comma-separated text of ranges; "[]" and "" are none."""
    if isinstance(texts, str):
        texts = [x for x in re.split(r"[\s,]+", texts.strip().strip("[]")) if x]
    return [parse_range(x.strip("'\"")) for x in texts]


def in_ranges(chrom: Column, bp: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """Whether a position lies in one of the given ranges (as many as were typed): a pushed-down predicate, no join."""
    out = F.lit(False)
    for c, lo, hi in ranges:
        out = out | ((chrom.cast("string") == c) & bp.between(lo, hi))
    return F.coalesce(out, F.lit(False))


def exclude_ranges(df: DataFrame, ranges: list[tuple[str, int, int]], chrom: str = "chr", bp: str = "bp") -> DataFrame:
    return df.where(~in_ranges(F.col(chrom), F.col(bp), ranges))


def parse_chromosomes(text: str) -> list[int]:
    """"21-22" or "1,3,5-7"."""
    out: list[int] = []
    for part in text.split(","):
        lo, _, hi = part.strip().partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return out


def chromosomes(df: DataFrame, text: str, chrom: str = "chr") -> DataFrame:
    """Rows of the named chromosomes; prunes partitions of a table that is partitioned by chromosome."""
    return df.where(F.col(chrom).isin(parse_chromosomes(text)))


def interval_join(points: DataFrame, intervals: DataFrame, flank: int = 0, bin_bp: int = 200_000, chrom: str = "chr", bp: str = "bp", start: str = "gstart", end: str = "gend") -> DataFrame:
    """Points with every interval, widened by `flank` on both sides, that holds them.

    Bins are narrower than most genes, so that few candidates fail.  Both sides
    are shuffled by bin whatever their sizes: a small file gives many rows here,
    and if one side were broadcast, the one task that reads the file would make
    them all.
    """
    lo, hi = F.greatest(F.col(start) - flank, F.lit(0)), F.col(end) + flank
    spread = intervals.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / bin_bp), F.floor(F.col("_hi") / bin_bp)))).withColumnRenamed(chrom, "_chrom")
    binned = points.withColumn("_bin", F.floor(F.col(bp) / bin_bp))
    held = (binned[chrom] == spread["_chrom"]) & (binned["_bin"] == spread["_bin"]) & F.col(bp).between(F.col("_lo"), F.col("_hi"))
    return binned.join(spread.hint("merge"), held).drop("_bin", "_chrom", "_lo", "_hi")


def anti_interval_join(points: DataFrame, intervals: DataFrame, bin_bp: int = 1_000_000, chrom: str = "chr", bp: str = "bp", start: str = "gstart", end: str = "gend") -> DataFrame:
    """Points in none of the intervals of a table of any size."""
    spread = intervals.select(F.col(chrom).alias("_chrom"), F.col(start).alias("_lo"), F.col(end).alias("_hi"), F.explode(F.sequence(F.floor(F.col(start) / bin_bp), F.floor(F.col(end) / bin_bp))).alias("_ibin"))
    binned = points.withColumn("_bin", F.floor(F.col(bp) / bin_bp))
    held = (F.col(chrom) == F.col("_chrom")) & (F.col("_bin") == F.col("_ibin")) & F.col(bp).between(F.col("_lo"), F.col("_hi"))
    return binned.join(spread, held, "left_anti").drop("_bin")


def window_pairs(points: DataFrame, window: int, position: str, partition: str | None = None) -> DataFrame:
    """Ordered pairs of rows at most `window` apart: struct columns a and b.

    Bins are as wide as the window; the first row of a pair is sent to its
    bin and the next one, so each pair meets once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    b = F.floor(F.col(position) / (window + 1))
    part = F.col(partition) if partition else F.lit(0)
    left = points.select(row.alias("a"), part.alias("_p"), F.explode(F.array(b, b + 1)).alias("_bin"))
    right = points.select(row.alias("b"), part.alias("_p"), b.alias("_bin"))
    gap = F.col(f"b.{position}") - F.col(f"a.{position}")
    return left.join(right, ["_p", "_bin"]).where((gap > 0) & (gap <= window)).select("a", "b")


def ranges_table(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(ranges, "chr string, gstart long, gend long")
