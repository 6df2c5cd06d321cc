"""Intermediate tables stored in the folder that the driver and every executor share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only on a local master, where every thread sees it.
LOCAL_DIR = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set by setCheckpointDir; a local default for a local master only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_DIR


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: readers see one and the same rows, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has already stopped: the cluster's own cleaning takes over
            return
