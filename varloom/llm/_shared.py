"""Helpers that several operators need: the shared folder, written tables, names."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.shared import importable

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may go without that
    setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_varloom_dir", None)
    if d:
        return d
    if not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc._varloom_dir = "file://" + tempfile.mkdtemp(prefix="varloom-")
    return sc._varloom_dir


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; `release` or the session's end removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/varloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written() -> int:
    """A mark for `tidy`."""
    return len(_written)


def tidy(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written since `mark` but those of `keep`: steps on the way to them that nothing reads again."""
    kept = {getattr(df, "_varloom_path", None) for df in keep}
    later = _written[mark:]
    del _written[mark:]
    for spark, path in later:
        if path in kept:
            _written.append((spark, path))
        else:
            _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor.
    """
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete what `workspace` and `materialize` have made so far."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; its folder goes with it
            return


atexit.register(release)


def bounded_batches(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> None:
    """Hand texts to Python in batches of bounded rows and bytes.

    The default of 10,000 rows a batch is for short values; with whole texts
    a batch, held by the JVM and by each Python worker of a chain, would fill
    an executor.  The session's limits are only ever lowered.
    """
    importable(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.match(r"-?\d+", spark.conf.get(name))
        if not now or int(now[0]) <= 0 or int(now[0]) > most:
            spark.conf.set(name, str(most))


def hash_sample(df: DataFrame, rows: int, most: int, *columns: str) -> DataFrame:
    """At most `most` of `rows` rows, those with the smallest hashes of the columns.

    A bound on the hash lets through a little fewer than `most` rows, so what
    reaches the driver or one task is as small for any number of partitions.
    """
    h = F.xxhash64(*columns)
    if rows > most:
        share = max(1.0, most - 4 * math.sqrt(most)) / rows
        df = df.where(h < F.lit(-(1 << 63) + int(share * (1 << 64))))
    return df.orderBy(h, *columns).limit(most)


def with_totals(rows: DataFrame, totals: DataFrame, key: str, total: int, most: int = 100_000, least: int = 1024) -> DataFrame:
    """`rows` joined to `totals` (one row a key; `n`: about how many of `rows` hold the key) without a hot key in one task.

    `total` is the number of rows.  At most `most` keys can hold more than
    total / most of them each; these are joined by broadcast where their rows
    lie, and only rows of the other keys are shuffled by key.
    """
    bar = max(least, -(-total // most))
    totals = materialize(totals, "totals")
    hot, cold = totals.where(F.col("n") > bar), totals.where(F.col("n") <= bar)
    held = rows.join(F.broadcast(hot), key)  # at most `most` keys
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return held.unionByName(rest)


def with_output(df: DataFrame, **columns) -> DataFrame:
    """Add an operator's columns; an input column of the same name (in any case) is replaced."""
    names = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
