"""Small helpers around the session: shared folders, tables, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one
    machine only (a local master), a temporary one where the session has none."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        known = tempfile.mkdtemp(prefix="pixelquill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of new_path that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder; cuts lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch; texts are long, and a batch stands in memory several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless it has a lower bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of tables in the shared folder; smaller than the default one.
COMPRESSION = "zstd"


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """The rows in a table of the shared folder, read back.

    For loops: unlike a checkpoint, the table carries no constraints that the optimizer
    has inferred, which pile up from round to round."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if more than one row in HOT_SHARE has it; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """Inner join of rows, of which any number may share a key, with a table of one row per key.

    The hot keys (HOT_SHARE at most, by definition) are joined by a broadcast of their
    rows of the table, so none of them meets in one task; all others by an exchange.
    `rows` is read three times, so keep it first; null keys join with nothing."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_times")).where("_times > 1")
    total = rows.count()
    hot = kept(counted.where(F.col("_times") * HOT_SHARE > total).select(key))
    few = kept(by_key.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(by_key, key)
    return rows.join(F.broadcast(few), key).unionByName(rest)
