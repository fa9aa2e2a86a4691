"""Merging repeated runs to one row per configuration and environment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups

RUN_KEYS = ("dataset", "task", "model", "architecture", "software")


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumn("configuration", F.concat_ws(" - ", "task", "dataset", "model")).withColumn(
        "environment", F.concat_ws(" - ", "architecture", "software")
    )


def merge_runs(runs: DataFrame, order: str = "log_name", digits: int | None = None) -> DataFrame:
    """Mean of numeric columns and first (by ``order``) non-null text per configuration and environment.

    Numbers are one hash aggregate.  Texts have an aggregate of their own, because a minimum of texts has to be
    sorted; it reads the keys and texts only.  ``digits`` rounds the means, for comparing runs of engines that
    sum in another order.
    """
    texts, numbers = [], []
    for field in runs.schema.fields:
        if field.name in RUN_KEYS:
            continue
        (texts if field.dataType.typeName() == "string" else numbers).append(field.name)

    def mean(column: str):
        return F.avg(column) if digits is None else F.round(F.avg(column), digits)

    merged = runs.groupBy(*RUN_KEYS).agg(F.count("*").alias("n_results"), *[mean(n).alias(n) for n in numbers])
    if texts and runs.isStreaming:
        merged = runs.groupBy(*RUN_KEYS).agg(
            F.count("*").alias("n_results"), *[_first_text(t, order).alias(t) for t in texts], *[mean(n).alias(n) for n in numbers]
        )
    elif texts:
        firsts = runs.select(*RUN_KEYS, *dict.fromkeys([order, *texts])).groupBy(*RUN_KEYS).agg(
            *[_first_text(t, order).alias(t) for t in texts]
        )
        merged = join_groups(merged, firsts, RUN_KEYS)
    return with_identity(merged.select(*RUN_KEYS, "n_results", *texts, *numbers)).drop("architecture", "software")


def _first_text(text: str, order: str):
    return F.min(text) if text == order else F.min_by(text, F.when(F.col(text).isNotNull(), F.col(order)))
