"""Dense numbers for ids of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize


def dense_ids(df: DataFrame, column: str, number: str = "number") -> DataFrame:
    """(column, number): the distinct ids of ``column`` numbered from 0 in their own order.

    Range partitions are written sorted; a number is the place inside the partition plus
    the sizes of the partitions before, so no task sees more than its range.  Null has no number.
    """
    ids = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranged = ids.repartitionByRange(column).sortWithinPartitions(column)
    stored = materialize(ranged.withColumn("__part", F.spark_partition_id()), "dense-ids")
    sizes = stored.groupBy("__part").agg(F.count("*").alias("__size"))  # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    placed = stored.withColumn("__place", place)
    return placed.join(F.broadcast(offsets), "__part").select(
        column, (F.col("__offset") + F.col("__place")).cast("long").alias(number)
    )
