"""Measurement views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.scalars import DIGITS
from gaugewright.operators.merge import merge_runs
from gaugewright.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; the workers get this package with the first."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_view(table(spark, folder, "lineitem"), table(spark, folder, "part"))


def run_view(line: DataFrame, part: DataFrame) -> DataFrame:
    """One raw measurement per line item; the part table is the data-set dimension."""
    part = part.select("p_partkey", "p_brand", "p_size")
    third_model = (F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 10 == 3)
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("log_name"),
        F.col("p_brand").alias("dataset"),
        F.col("l_returnflag").alias("task"),
        F.concat(F.lit("Arch "), "l_linestatus").alias("architecture"),
        F.lit("Engine 1.0").alias("software"),
        F.concat(F.lit("M"), F.col("l_suppkey") % 10).alias("model"),
        (1 - F.col("l_discount")).alias("accuracy"),
        (1 - F.col("l_tax")).alias("f1"),
        F.when(~third_model, F.col("l_quantity") / 50).alias("precision"),
        F.when(F.col("l_returnflag") == "A", (F.col("l_quantity") + F.col("l_linenumber")) / 57).alias("recall"),
        (F.col("l_linenumber") * (F.col("l_suppkey") % 10)).cast("double").alias("parameters"),
        F.col("p_size").cast("double").alias("fsize"),
        (F.col("l_extendedprice") / 50).alias("train_power_draw"),
        F.col("l_quantity").alias("train_running_time"),
        (F.col("l_extendedprice") / 1000).alias("power_draw"),
        (F.col("l_quantity") / F.col("l_linenumber")).alias("running_time"),
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """The runs merged to one row per configuration and environment, with means in a fixed number of digits."""
    return merge_runs(runs(spark, folder).drop("log_name"), digits=DIGITS)
