"""Distributed prefix sums: range-sort, sum per range, add what earlier ranges hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.llm.store import materialize


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Return (rows, ranges).

    rows is df with ``before``: the sum of ``value`` over the rows of the same group that sort earlier.
    ranges has one row per group and range with its ``total``; group totals follow from it.
    ``group`` must not be null. A hot group spans many ranges, so no task holds it whole; the
    ranges are stored once, because a range split sampled anew could fall differently.
    """
    ranged = materialize(
        df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    ranges = ranged.groupBy(group, "_range").agg(F.sum(value).alias("total"))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    inside = W.partitionBy(group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets.drop("total"), [group, "_range"])
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_range")
    )
    return rows, ranges
