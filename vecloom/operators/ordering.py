"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.runtime import Scratch, shuffle_partitions


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based place in a total order.

    Rows are range-partitioned and sorted, the partitions' sizes (one row each) make the offsets, and a
    window within each partition counts on from its offset.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "positions")
    spread = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    spread = scratch.save(spread, "spread")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__from"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return spread.withColumn("__at", within).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__from")).drop("__part", "__at", "__from")
