"""An addition of ours: harmonisation of summary-statistics files as they arrive.

The reference workflow is batch only; this applies the same cleaning to a
stream of files, so a study picks up new ones without a rebuild.  All steps
are row by row, so no state and no watermark are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from varloom.operators.harmonize import clean
from varloom.schema import SUMSTATS, nan_to_null


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated files in the standard columns, those there and those to come."""
    return nan_to_null(spark.readStream.schema(SUMSTATS).csv(folder, sep="\t", header=True, nanValue="nan"))


def write(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Cleaned rows as Parquet by chromosome; each file is taken exactly once."""
    out = clean(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("CHR")
    return (out.trigger(availableNow=True) if once else out).start()
