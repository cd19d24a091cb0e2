"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a local session without it gets a temporary folder."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_varloom_folder", None)
    if not d:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = sc._varloom_folder = "file://" + tempfile.mkdtemp(prefix="varloom-")
    sc.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    It is sent along unless it is installed, or the workers run on this
    machine with this path: folders of the driver say nothing about a cluster.
    """
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = (sc.master or "").startswith("local[") or sc.master == "local"
    if (here and (root in on_path or Path.cwd() == root)) or "site-packages" in root.parts or getattr(sc, "_varloom_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="varloom-")) / "varloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "varloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._varloom_sent = True
