"""Ranks and running sums within groups of any size: no group is gathered in one task.

Rows are range-partitioned by group and order, so that a large group lies in several partitions that follow one another;
each is summed by itself, and moved by the sums of the group's partitions before. The partitioned rows are written once,
since a second evaluation could draw the borders elsewhere. Groups are told apart by equality: their columns hold no null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def running_sum(df: DataFrame, group: list[str], order: list, value, name: str) -> DataFrame:
    """df with the sum of the value over the rows of its group up to and with its own."""
    keys = [F.col(c) for c in group] + order
    ranged = cut_lineage(df.withColumn("_value", value).repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()), "ranged")
    so_far = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("_pid", *group).agg(F.sum("_value").alias("_n"))
    before = sums.select("_pid", *group, (F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid")) - F.col("_n")).alias("_before"))
    both = ranged.withColumn("_local", F.sum("_value").over(so_far)).join(before, ["_pid", *group])
    return both.withColumn(name, F.col("_local") + F.col("_before")).drop("_value", "_pid", "_local", "_before")


def rank_within(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with the row number within its group."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name)
