"""Positions within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import Scratch


def positions(scratch: Scratch, df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """`df` with each row's position, from 1, in its group under `order`.

    Rows are range-partitioned and sorted by group and order; a row's position is its place in its partition less
    the group's first place there, plus the group's rows in earlier partitions. Those counts have one row for each
    group a partition holds. `order` must tell all rows of a group apart for the result to be determined.
    """
    laid = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    laid = scratch.write(laid.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition at most
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = laid.join(before, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
