"""Running totals and places over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.session import cut


def running_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows that come before in the order (0 for the first).

    Rows are range-partitioned by the order and written to the checkpoint folder once, which pins the ranges; sums per
    range (one row each) give each range its start, and a window within the range does the rest. Equal rows keep
    together: ties must be broken by the order itself.
    """
    keyed = df.select("*", *[o.alias(f"__before_o{i}") for i, o in enumerate(order)], value.alias("__before_v"))
    names = [f"__before_o{i}" for i in range(len(order))]
    placed = cut(keyed.repartitionByRange(*names).withColumn("__before_p", F.spark_partition_id()))
    starts = placed.groupBy("__before_p").agg(F.sum("__before_v").alias("__before_s"))
    starts = starts.select("__before_p", F.coalesce(F.sum("__before_s").over(Window.partitionBy(F.lit(0)).orderBy("__before_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before_start"))
    inside = F.coalesce(F.sum("__before_v").over(Window.partitionBy("__before_p").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(starts), "__before_p").withColumn(name, F.col("__before_start") + inside).drop("__before_p", "__before_v", "__before_start", *names)


def places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in the order; descending keys are given as negated or with their sort key."""
    return running_before(df, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + 1)
