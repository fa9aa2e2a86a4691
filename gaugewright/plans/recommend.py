"""Long predictions: errors, real values, compound scores and recommendations.

A prediction row is (configuration, dataset, task, environment, model, property, pred).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import DIGITS, index_to_value, quoted, settle
from gaugewright.meta import GROUP_KEYS
from gaugewright.operators.compare import top_per_group
from gaugewright.operators.compound import combine_custom
from gaugewright.operators.index import idx
from gaugewright.operators.joins import join_groups

ROW_ID = ("configuration", "environment")


def recalculate_values(predictions: DataFrame, rated: DataFrame, references: DataFrame, properties) -> DataFrame:
    """Predicted indices as property values, with the error truth - prediction."""
    cells = F.array(*[
        F.struct(
            F.lit(p.key).alias("property"), F.lit(p.maximize).alias("maximize"),
            F.col(p.key).alias("value"), F.col(f"{p.key}__ref").alias("ref"),
        )
        for p in properties
    ])
    truth = join_groups(rated, references, list(GROUP_KEYS), "inner").select(*ROW_ID, F.inline(cells))
    joined = join_groups(predictions, truth, [*ROW_ID, "property"], "inner")
    value = F.expr(f"if(maximize, {index_to_value('pred', 'ref', True)}, {index_to_value('pred', 'ref', False)})")
    return joined.withColumn("pred_value", value).withColumn("err", F.col("value") - F.col("pred_value")).drop("maximize")


def compound_predictions(predictions: DataFrame, properties) -> DataFrame:
    """Weighted mean of the predicted indices of all properties of a row."""
    wide = predictions.groupBy(*ROW_ID, "dataset", "task", "model").agg(
        *[F.max(F.when(F.col("property") == p.key, F.col("pred"))).alias(p.key) for p in properties]
    )
    score = combine_custom([(quoted(p.key), p.weight) for p in properties])
    return wide.withColumn("compound_pred", F.expr(settle(score)))


def truth_table(rated: DataFrame, properties) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(p.key).alias("property"), F.col(idx(p.key)).alias("truth")) for p in properties])
    return rated.select(*ROW_ID, F.inline(cells))


def with_truth(predictions: DataFrame, rated: DataFrame, properties) -> DataFrame:
    """Prediction next to the measured index; the error is prediction - truth."""
    return join_groups(predictions, truth_table(rated, properties), [*ROW_ID, "property"], "inner").withColumn(
        "err", F.round(F.col("pred") - F.col("truth"), DIGITS)
    )


def recommend(scored: DataFrame, score: str = "pred") -> DataFrame:
    """Best row per environment and data set by a predicted score; equal scores take the first model."""
    return top_per_group(scored, ["environment", "dataset"], score, ["model", "configuration"], ["model", "configuration"])
