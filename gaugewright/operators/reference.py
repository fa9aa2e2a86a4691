"""Reference models: the most average model of a group, and indices centred on a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import double, quoted, settle, value_to_index
from gaugewright.meta import GROUP_KEYS
from gaugewright.operators.index import add_indices, long_cells
from gaugewright.operators.joins import join_groups
from gaugewright.operators.quantiles import exact_quantiles
from gaugewright.operators.ranking import ordered_rank


def median_scores(df: DataFrame, properties, keys=GROUP_KEYS) -> DataFrame:
    """Weighted sum per model of its indices against the group's median values (missing values count 0)."""
    medians = exact_quantiles(
        long_cells(df, properties, keys, ("value",)), [*keys, "property"], "value", [0.5], "median"
    )
    wide = medians.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN property = '{p.key}' THEN median[0] END) AS {quoted(p.key + '__median')}") for p in properties]
    )
    score = " + ".join(
        f"coalesce(({value_to_index(quoted(p.key), quoted(p.key + '__median'), p.maximize)}) * {double(p.weight)}, 0D)"
        for p in properties
    )
    return join_groups(df, wide, keys).selectExpr(*keys, "model", f"{settle(f'({score})')} AS score")


def optimal_references(df: DataFrame, properties, keys=GROUP_KEYS) -> DataFrame:
    """Per group the model in position ``n // 2`` of the ascending score; equal scores in model order."""
    ranked = ordered_rank(median_scores(df, properties, keys), list(keys), ["score", "model"])
    return ranked.filter("rank = group_size div 2").select(*keys, F.col("model").alias("reference"), "score")


def group_references(df: DataFrame, properties, given: DataFrame | None = None) -> DataFrame:
    """Reference model of every group.

    The first group of a data set (in task, environment order) decides for the whole data set unless
    ``given`` (dataset, reference) names one; a group without that model uses its own optimal reference.
    """
    own = optimal_references(df, properties)
    per_dataset = own.groupBy("dataset").agg(F.min_by("reference", F.struct("task", "environment")).alias("first"))
    if given is not None:
        per_dataset = per_dataset.join(given.select("dataset", F.col("reference").alias("named")), "dataset", "left").select(
            "dataset", F.coalesce("named", "first").alias("first")
        )
    wanted = join_groups(own, per_dataset, ["dataset"])
    has = df.select(*GROUP_KEYS, F.col("model").alias("first"), F.lit(True).alias("has"))
    return join_groups(wanted, has, [*GROUP_KEYS, "first"]).select(
        *GROUP_KEYS, F.when(F.col("has"), F.col("first")).otherwise(F.col("reference")).alias("reference")
    )


def centered_references(df: DataFrame, references: DataFrame, properties) -> DataFrame:
    """Values of the reference model per group, and whether the group has the property at all."""
    joined = join_groups(df, references, GROUP_KEYS)
    return joined.groupBy(*GROUP_KEYS).agg(
        *[F.max(F.when(F.col("model") == F.col("reference"), F.col(p.key))).cast("double").alias(f"{p.key}__ref") for p in properties],
        *[(F.count(p.key) > 0).alias(f"{p.key}__present") for p in properties],
    )


def index_centered(df: DataFrame, properties, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with indices relative to the reference model, and the reference per group."""
    references = group_references(df, properties, given)
    return add_indices(df, centered_references(df, references, properties), properties), references
