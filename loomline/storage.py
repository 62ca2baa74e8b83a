"""Tables written between steps in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset on a local master, as in tests, a local one."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if set_already:
        return set_already.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = Path(tempfile.mkdtemp(prefix="loomline-")).as_uri()
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir() or own
    return own.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    Unlike checkpoint() the result carries no partitioning over, so that a join on it is an ordinary one that
    adaptive execution can split where it is skewed. The folder goes when the JVM ends, or with `drop_table`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # for drop_table
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what stage_table wrote; nothing may read it any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now.

    It deletes them when the driver's JVM finds that no plan refers to them, which may take it half an hour; until then
    the steps of a long job add up on the executors' disks.
    """
    gc.collect()  # the Python sides of plans hold the JVM's
    spark._jvm.System.gc()
