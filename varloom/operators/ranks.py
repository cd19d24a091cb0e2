"""Exact order statistics of groups of any size, by refining histograms.

Each round counts the values of a group in a fixed number of buckets between
the lowest and the highest value that are still in question, and keeps the
bucket that holds the wanted rank, by its own lowest and highest value.  Only
counts are shuffled; no task holds a group's values, however large it is.  A
round sets the lowest and the highest value apart, so it always gets on; evenly
spread values end after the logarithm of their number to the base `buckets`.

Null and NaN are no values.  Ties need no rule: equal values share a bucket to
the end.  A group without values, and rows whose group is null, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.sources.shared import written

BUCKETS = 4096


def rank_values(df: DataFrame, value: str, by: str, rank: Column, buckets: int = BUCKETS) -> DataFrame:
    """One row a group: `by`, n (its values), value (the one of the 0-based `rank`, a column of n) and below (how many are lower).

    A rank beyond the last counts as the last, one below 0 as 0.
    """
    rows = df.select(F.col(f"`{by}`").alias("_by"), F.col(f"`{value}`").alias("_v")).where("_by is not null and _v is not null and not isnan(_v)")
    state = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.withColumn("_rank", F.greatest(F.lit(0), F.least(rank, F.col("n") - 1)).cast("long")).withColumn("below", F.lit(0).cast("long"))
    state = written(state, "ranks")
    # Halves, so that the width of any range is finite; an infinite end puts all between the ends into one bucket.
    half = lambda c: F.col(c).cast("double") / 2
    place = F.nanvl(F.try_divide(half("_v") - half("_lo"), half("_hi") - half("_lo")), F.lit(0.0))
    bucket = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), buckets + 1).otherwise(1 + F.least(F.lit(buckets - 1), F.floor(F.coalesce(place, F.lit(0.0)) * buckets)))
    upto = Window.partitionBy("_by").orderBy("_b")  # at most buckets + 2 rows a group
    while state.where("_lo < _hi").take(1):
        inside = rows.join(state.where("_lo < _hi").select("_by", "_lo", "_hi"), "_by").where("_v between _lo and _hi")
        counts = inside.groupBy("_by", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        found = counts.withColumn("_cum", F.sum("_c").over(upto)).join(state.select("_by", "n", "_rank", "below"), "_by")
        found = found.where((F.col("below") + F.col("_cum") > F.col("_rank")) & (F.col("below") + F.col("_cum") - F.col("_c") <= F.col("_rank")))
        found = found.select("_by", "n", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_rank", (F.col("below") + F.col("_cum") - F.col("_c")).alias("below"))
        state = written(state.where("_lo = _hi").unionByName(found), "ranks")
    return state.select(F.col("_by").alias(by), "n", F.col("_lo").alias("value"), "below")


def exact_median(df: DataFrame, value: str, by: str, median: str = "median", buckets: int = BUCKETS) -> DataFrame:
    """One row a group: `by` and the median, the mean of the two middle values where their number is even."""
    lower = rank_values(df, value, by, F.floor((F.col("n") - 1) / 2), buckets).select(F.col(by).alias("_by"), "n", F.col("value").alias("_low"))
    rows = df.select(F.col(f"`{by}`").alias("_by"), F.col(f"`{value}`").alias("_v")).where("_v is not null and not isnan(_v)").join(lower, "_by")
    upto, after = F.count_if(F.col("_v") <= F.col("_low")), F.min(F.when(F.col("_v") > F.col("_low"), F.col("_v")))
    ends = rows.groupBy("_by").agg(F.first("n").alias("n"), F.first("_low").alias("_low"), upto.alias("_upto"), after.alias("_after"))
    high = F.when((F.col("n") % 2 == 1) | (F.col("_upto") * 2 > F.col("n")), F.col("_low")).otherwise(F.col("_after"))
    return ends.select(F.col("_by").alias(by), (F.col("_low").cast("double") * 0.5 + high.cast("double") * 0.5).alias(median))


def lowest(df: DataFrame, value: str, by: str, n: int, tie: str) -> DataFrame:
    """The n rows of lowest `value` of each group (all, if fewer); equal values by `tie`.  Only rows equal to the last value are ranked."""
    last = rank_values(df, value, by, F.lit(n - 1)).select(F.col(by).alias("_by"), F.col("value").alias("_last"), "below")
    rows = df.join(last, F.col(by) == F.col("_by"))
    equal = rows.where(F.col(value) == F.col("_last")).withColumn("_place", F.row_number().over(Window.partitionBy("_by").orderBy(tie)))
    return rows.where(F.col(value) < F.col("_last")).select(*df.columns).unionByName(equal.where(F.col("below") + F.col("_place") <= n).select(*df.columns))
