"""Positions in one order over a whole table, without a task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.session import stage


def positions(frame: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """The frame with each row's number from 1 in the order (columns by name), which should decide between any two rows.

    Rows are dealt into ranges of the order and stored; ranges are counted, and each row's number is that inside its
    range and what the ranges before it hold.
    """
    ranged = frame.repartitionByRange(parts, *order) if parts else frame.repartitionByRange(*order)
    dealt = stage(ranged.withColumn("order_part", F.spark_partition_id()), "order")
    sizes = dealt.groupBy("order_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    ahead = F.coalesce(F.sum("n").over(W.orderBy("order_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = W.partitionBy("order_part").orderBy(*order)
    return dealt.join(F.broadcast(sizes.select("order_part", ahead.alias("ahead"))), "order_part").withColumn(name, F.col("ahead") + F.row_number().over(inside)).drop("ahead", "order_part")
