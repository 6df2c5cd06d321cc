"""Ordinals and running sums over a whole table without sorting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.functions.storage import stored


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that sort before a row by ``order`` (a unique column).

    Rows are range-partitioned; only one number per range goes through a single task. The ranged
    rows are stored, so both readers see one and the same split.
    """
    ranged = stored(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(value).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(offsets, "_range")
        .withColumn(name, (F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_range", "_offset")
    )


def with_ordinal(df: DataFrame, order: str, name: str = "doc_idx") -> DataFrame:
    """Add dense ordinals from 0 in ascending order of a unique column."""
    return running(df.withColumn("_one", F.lit(1)), order, "_one", name).drop("_one")
