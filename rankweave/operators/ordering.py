"""Numbers and running totals along an order, without bringing all rows to one task.

Rows are dealt out by ranges of the order; what lies in earlier ranges is added from the ranges' own
sums, of which there are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import cut


def _ranged(rows: DataFrame, order: str, value: F.Column) -> tuple[DataFrame, DataFrame]:
    parts = cut(rows.withColumn("_v", value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("_v").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts, sums.select("_part", before.alias("_before"))


def ordinals(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """``rows`` numbered from 0 along a column of distinct values."""
    parts, offsets = _ranged(rows, order, F.lit(1).cast("long"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_at", within).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before", "_v")


def running_total(rows: DataFrame, order: str, value: str, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, along a column of distinct values."""
    parts, offsets = _ranged(rows, order, F.col(value))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_at", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before", "_v")
