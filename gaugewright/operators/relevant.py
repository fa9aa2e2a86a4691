"""Which properties matter for a data set and task, and what to plot them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups


def relevant_metrics(df: DataFrame, properties) -> DataFrame:
    """Per (dataset, task) the usable properties by ascending weight and the default axes.

    A property counts if the task has values, or the data set has and the property does not depend on the
    task.  Rows with fewer than two properties or without an x axis are left out.
    """
    by_task = df.groupBy("dataset", "task").agg(*[F.count(p.key).alias(p.key) for p in properties])
    by_set = df.groupBy("dataset").agg(*[F.count(p.key).alias(f"{p.key}__set") for p in properties])
    joined = join_groups(by_task, by_set, ["dataset"], "inner")
    entries = F.array(*[
        F.when(
            (F.col(p.key) > 0) | (F.lit(p.independent) & (F.col(f"{p.key}__set") > 0)),
            F.struct(F.lit(p.weight).alias("weight"), F.lit(i).alias("pos"), F.lit(p.key).alias("key"), F.lit(p.group).alias("grp")),
        )
        for i, p in enumerate(properties)
    ])
    found = joined.select("dataset", "task", F.array_sort(F.filter(entries, lambda e: e.isNotNull())).alias("m"))

    def nth_last(group: str, n: int) -> Column:
        inside = F.filter(F.col("m"), lambda e: e["grp"] == group)
        return F.try_element_at(inside, F.lit(-n))["key"]

    return found.filter(F.size("m") >= 2).select(
        "dataset", "task", F.transform("m", lambda e: e["key"]).alias("metrics"),
        nth_last("Performance", 1).alias("y_axis"),
        F.coalesce(nth_last("Resources", 1), nth_last("Complexity", 1), nth_last("Performance", 2)).alias("x_axis"),
    ).filter("x_axis IS NOT NULL").withColumn(
        "y_axis", F.coalesce("y_axis", F.raise_error(F.lit("a data set has no quality property")).cast("string"))
    )
