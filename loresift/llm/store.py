"""Intermediate tables in the folder that the driver and every executor share.

A table written here replaces lineage: a lost executor costs a re-read, not a recompute.
The folder is the one named in ``spark.checkpoint.dir``; only where that is unset (tests,
one machine) a local default is used.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only on a local master, where every thread sees it.
DEFAULT_DIR = "/tmp/checkpoints"
#: Bytes of a table that is sent to every executor at most, and what a row of fixed width counts.
SMALL_BYTES = 64 << 20
ROW_BYTES = 64

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set by setCheckpointDir; a local default for a local master only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or DEFAULT_DIR


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def expect(spark: SparkSession, path: str) -> None:
    """Have a folder that the caller writes deleted at the end of the driver."""
    _written.append((spark, path))


def discard(table: DataFrame) -> None:
    """Delete a table that materialize() returned and that nothing lazy still reads."""
    _delete(table.sparkSession, table._stored_at)
    _written[:] = [x for x in _written if x[1] != table._stored_at]


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files behind stored tables deleted now, not when the driver happens to collect its garbage.

    What Python lets go of reaches the JVM a moment later, so twice.
    """
    for wait in (0.5, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(wait)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(table: DataFrame, size: Column | None = None, most: int = SMALL_BYTES) -> DataFrame:
    """Broadcast a stored table if it is measured to be small, else leave the join to a shuffle.

    size: bytes of a row's values of no fixed width, 0 where there are none. A row counts ROW_BYTES besides.
    """
    rows, wide = table.agg(F.count("*"), F.sum(size if size is not None else F.lit(0))).first()
    return F.broadcast(table) if rows * ROW_BYTES + (wide or 0) <= most else table


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns, as text: two hashes that start apart."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *columns)), 16, "0") for k in (1, 2)])


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has already stopped: the cluster's own cleaning takes over
            return
