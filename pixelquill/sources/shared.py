"""The folder that driver and executors share, and rows that are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a local master has none."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        known = tempfile.mkdtemp(prefix="pixelquill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """The rows written once in the shared folder; every later use reads the same ones."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
