"""Scores of predictions: classification metrics and error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, keys=()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_scores(df: DataFrame, truth: str, pred: str, keys=()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; empty denominators count 0.

    Everything after the first aggregation works on the confusion table.
    """
    counts = confusion(df, truth, pred, keys)
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    per_class = counts.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    weighted = lambda c: F.try_divide(F.sum(c * F.col("support")), F.sum("support"))
    return per_class.groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"), weighted(recall).alias("recall"), weighted(f1).alias("f1"),
    )


def in_top_k(scores: Column, label: Column, k: int) -> Column:
    """Whether the score at position ``label`` is among the k highest; equal scores favour later positions."""
    own = F.get(scores, label)
    better = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i > label)))
    return (F.size(scores) <= k) | (F.size(better) < k)


def error_summary(df: DataFrame, error: str, keys) -> DataFrame:
    """Mean, sample deviation and maximum of the absolute error."""
    size = F.abs(F.col(error))
    return df.groupBy(*keys).agg(
        F.avg(size).alias("mae"), F.stddev_samp(size).alias("std"), F.max(size).alias("max_error")
    )
