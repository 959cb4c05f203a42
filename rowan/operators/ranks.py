"""Ranks over whole tables without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowan.session import cut_lineage


def average_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, rank: the rank of each value within its group, of ties the average; NULL values have none.

    Values are counted first, then split by range over all tasks; each task ranks its own range and adds the
    number of values before it. Only one number for each group and task is gathered.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    parts = cut_lineage(counted.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part", *groups).agg(F.sum("_n").alias("_all"))
    before = totals.withColumn("_before", F.sum("_all").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_all")).drop("_all")
    inside = F.sum("_n").over(Window.partitionBy("_part", *groups).orderBy(value)) - F.col("_n")
    ranked = parts.withColumn("_inside", inside).join(before, ["_part", *groups])
    return ranked.select(*groups, value, (F.col("_before") + F.col("_inside") + (F.col("_n") + 1) / 2).alias("rank"))


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in an order of the whole table, without a task that sees all of it.

    Rows are split by range of the order's columns; each task numbers its own and adds how many are before them. Rows that tie in all columns of the
    order have some order among themselves.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")  # one row a task
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")
