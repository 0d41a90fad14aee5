"""Consecutive numbers in a global order, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise


def number_rows(df: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """The rows with consecutive numbers in the order of the given columns (which should be unique together).

    Rows are sorted by range into partitions and counted there; each partition continues after those before it.
    """
    parted = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.join(before, "_part").withColumn(name, inside + F.col("_before") + (start - 1)).drop("_part", "_before")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of value over all rows before them in the order of the given columns (unique together).

    Like number_rows: sums inside ranges, and one row for each range in a window over ranges.
    """
    parted = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.join(before, "_part").withColumn(name, inside + F.col("_before")).drop("_part", "_before")
