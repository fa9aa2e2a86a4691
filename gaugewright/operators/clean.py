"""Corrections, outliers, gaps and splits of the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.scalars import short_environment
from gaugewright.operators.joins import join_groups

# Highest plausible power in watt, models that are baselines, least budget in seconds.
MAX_WATT = 400
BASELINES = ("PFN", "AGL", "NAM", "PFN4", "PFN16", "PFN64", "PFN32")
MIN_BUDGET = 15


def override_sizes(df: DataFrame, corrections: DataFrame, columns=("parameters", "fsize")) -> DataFrame:
    """Replace columns by the correction of the same model and data set where there is one."""
    fixes = corrections.select("model", "dataset", *[F.col(c).alias(f"{c}__fix") for c in columns])
    joined = join_groups(df, fixes, ["model", "dataset"])
    return joined.withColumns({c: F.coalesce(f"{c}__fix", c) for c in columns}).select(*df.columns)


def drop_implausible_power(df: DataFrame, limit: float = MAX_WATT) -> DataFrame:
    """Energy that would need more than ``limit`` watt becomes missing."""
    pairs = {"train_power_draw": "train_running_time", "power_draw": "running_time"}
    return df.withColumns({e: F.when(F.col(e) > limit * F.col(t), None).otherwise(F.col(e)) for e, t in pairs.items()})


def complete_rows(df: DataFrame, properties) -> DataFrame:
    """Unknown parameter counts become 0, rows with any other gap are dropped."""
    return df.fillna({"parameters": 0.0}).dropna("any", subset=list(properties))


def split_models(df: DataFrame, baselines=BASELINES, keys=("configuration", "environment")):
    """Baseline rows, and all other rows by exclusion of the baseline row ids."""
    base = df.filter(F.col("model").isin(*baselines))
    return base, join_groups(df, base.select(*keys), list(keys), "left_anti")


def subset_datasets(complete: DataFrame, named: str = "credit-g", first: int = 6, last: int = 15) -> DataFrame:
    """Names of the data sets first seen at positions ``first`` to ``last``, and one named data set."""
    seen = complete.groupBy("dataset").agg(F.min(F.struct("environment", "configuration")).alias("seen"))
    head = seen.orderBy("seen").limit(last)  # at most ``last`` rows are numbered
    numbered = head.withColumn("position", F.row_number().over(Window.orderBy("seen")))
    picked = numbered.filter(F.col("position") >= first).select("dataset")
    return picked.union(complete.filter(F.col("dataset") == named).select("dataset").distinct()).distinct()


def _seconds(digits: int | None):
    total = F.sum("train_running_time")
    return total if digits is None else F.round(total, digits)


def budgets(df: DataFrame, minimum: int = MIN_BUDGET, digits: int | None = None) -> DataFrame:
    """Seconds of training time per short environment name and data set, never below the minimum."""
    total = _seconds(digits)
    return df.groupBy(short_environment(F.col("environment")).alias("architecture"), "dataset").agg(
        total.alias("seconds"), F.greatest(total.cast("long"), F.lit(minimum)).alias("budget")
    )


def environment_statistics(complete: DataFrame, baselines: DataFrame, properties, digits: int | None = None) -> DataFrame:
    """Complete rows of both parts and the total training time per environment."""
    def counted(df, name):
        return df.dropna("any", subset=list(properties)).groupBy("environment").agg(F.count("*").alias(name))

    times = complete.groupBy("environment").agg(_seconds(digits).alias("seconds"))
    return (
        join_groups(join_groups(times, counted(complete, "n_complete"), ["environment"]), counted(baselines, "n_baselines"), ["environment"])
        .fillna(0, ["n_complete", "n_baselines"])
    )


def union_databases(*databases: DataFrame) -> DataFrame:
    """Stack the tables of several machines by column name."""
    union = databases[0]
    for other in databases[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    return union


def replace_part(full: DataFrame, part: DataFrame, keys=("configuration", "environment")) -> DataFrame:
    """The full table with the rows of ``part`` put in place of their old versions."""
    return join_groups(full, part.select(*keys), list(keys), "left_anti").unionByName(part.select(*full.columns))
