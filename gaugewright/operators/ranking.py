"""Row numbers inside keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups
from gaugewright.session import materialize


def ordered_rank(df: DataFrame, keys: list[str], order: list, rank: str = "rank", size: str = "group_size"):
    """Zero-based rank of every row inside its key, and the size of the key.

    The rows are range-partitioned on key and order, so a hot key spreads over many partitions.  The
    placement is written to the shared folder once: the partition number has to be the same for the counts
    and for the rows.  ``order`` (names or sort columns) must be total inside a key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # one row per key and partition that holds rows of it
    offsets = (
        placed.groupBy(*keys, "_part").agg(F.count("*").alias("_here"))
        .withColumn("_upto", F.sum("_here").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(size, F.sum("_here").over(by_key))
        .withColumn("_offset", F.col("_upto") - F.col("_here"))
        .drop("_here", "_upto")
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        join_groups(placed, offsets, [*keys, "_part"], "inner")
        .withColumn(rank, F.col("_offset") + F.row_number().over(local) - 1)
        .drop("_part", "_offset")
    )
