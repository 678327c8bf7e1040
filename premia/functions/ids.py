"""Gapless row numbers over a distributed sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_table_path


def with_gapless_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``df`` with ids 1..n in the given order; rows equal in all of ``order`` are numbered in any order.

    Rows are range-partitioned and sorted, then written with their partition and place, so
    that a task run again cannot renumber what others have read. A partition's rows before
    it are a running sum over one row per partition, which every task gets; the rows themselves are
    not shuffled by their few partition numbers. No task sees more than its own rows.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.expr("monotonically_increasing_id() & 8589934591").alias("_place"))      # the low 33 bits
    path = new_table_path(spark, "gapless_ids")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").select((F.col("_before") + F.col("_place") + 1).alias(name), *df.columns)
