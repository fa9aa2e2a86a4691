"""Comparing models, environments and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.index import idx
from gaugewright.operators.joins import join_groups
from gaugewright.operators.quantiles import exact_quantiles
from gaugewright.operators.ranking import ordered_rank


def top_per_group(df: DataFrame, keys, score: str, ties, keep) -> DataFrame:
    """The whole row with the highest score per key, ties by the smallest ``ties`` columns.

    An aggregate instead of a window: each partition keeps one candidate per key before the shuffle.
    """
    best = F.min_by(F.struct(*keep, F.col(score).alias("_s")), F.struct(-F.col(score), *[F.col(t) for t in ties]))
    return df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(best.alias("_r")).select(
        *keys, *[F.col(f"_r.{k}").alias(k) for k in keep], F.col("_r._s").alias(score)
    )


def reference_values(df: DataFrame, properties, keys=("dataset", "task", "environment")) -> DataFrame:
    """Per group and property the value of the row with the highest index; ties take the first row."""
    # sort keys make the first row the smallest: descending index, then configuration
    return df.groupBy(*keys).agg(*[
        F.min_by(p.key, F.when(F.col(idx(p.key)).isNotNull(), F.struct(-F.col(idx(p.key)), F.col("configuration")))).alias(f"{p.key}__ref")
        for p in properties
    ])


def environment_spread(df: DataFrame, properties, keys=("dataset", "model")) -> DataFrame:
    """Sample deviation of each index over the rows of a data set and model, and their plain mean."""
    spread = df.groupBy(*keys).agg(*[F.stddev_samp(idx(p.key)).alias(p.key) for p in properties])
    total = sum((F.col(p.key) for p in properties[1:]), F.col(properties[0].key))
    return spread.withColumn("mean_spread", total / len(properties))


def min_max(df: DataFrame, keys, column: str, out: str) -> DataFrame:
    """Column scaled to [0, 1] inside each key; NULL where all values are equal."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return join_groups(df, ends, keys).withColumn(out, scaled).drop("_lo", "_hi")


def chain(df: DataFrame, keys, order: str, columns) -> DataFrame:
    """Every row joined to the next one of its key: segments of a line through ordered points."""
    ranked = ordered_rank(df.select(*keys, order, *columns), list(keys), [order])
    left = ranked.select(*keys, "rank", *[F.col(c).alias(f"{c}_from") for c in (order, *columns)])
    right = ranked.select(*keys, (F.col("rank") - 1).alias("rank"), *[F.col(c).alias(f"{c}_to") for c in (order, *columns)])
    return join_groups(left, right, [*keys, "rank"], "inner").drop("rank")


def energy(train="train_power_draw", inference="power_draw") -> Column:
    """Energy of a run, missing parts count 0."""
    return F.coalesce(F.col(train), F.lit(0.0)) + F.coalesce(F.col(inference), F.lit(0.0))


def cost_rows(df: DataFrame, recommended: DataFrame, baselines: DataFrame) -> DataFrame:
    """Accuracy and energy per environment and data set for three ways to get a model: the recommended one,
    an exhaustive search over all, and each baseline.

    ``recommended`` has (environment, dataset, model, configuration).
    """
    columns = ["environment", "dataset", "source", "accuracy", "energy"]
    rows = df.select("environment", "dataset", "model", "configuration", "accuracy", energy().alias("energy"))
    chosen = ["environment", "dataset", "configuration"]
    ours = join_groups(rows, recommended.select(*chosen), chosen, "inner")
    exhaustive = rows.groupBy("environment", "dataset").agg(
        F.max("accuracy").alias("accuracy"), F.sum("energy").alias("energy")
    )
    given = baselines.select(
        "environment", "dataset", F.col("model").alias("source"), "accuracy", energy().alias("energy")
    ).dropna()
    return (
        ours.withColumn("source", F.lit("OURS")).select(*columns)
        .unionByName(exhaustive.withColumn("source", F.lit("EXH")).select(*columns))
        .unionByName(given.select(*columns))
    )


def box_summary(df: DataFrame, keys, columns, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Row count and exact quartiles of some columns per key."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, F.inline(cells))
    quartiles = exact_quantiles(long, [*keys, "measure"], "value", probs, "q")
    counts = long.groupBy(*keys, "measure").agg(F.count("value").alias("n"))
    return join_groups(quartiles, counts, [*keys, "measure"])
