"""Principal components of standardized columns, per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.gram import moments, packed_grams, unpack
from gaugewright.operators.joins import join_groups
from gaugewright.operators.quantiles import stored_quantiles
from gaugewright.session import materialize


def loadings(df: DataFrame, keys: list[str], columns: list[str], components: int) -> DataFrame:
    """Per key the constant and the weights of every component on the raw columns.

    The sign of a component is chosen so that its largest loading (the first of those equal in nine digits) is positive.
    """
    width = len(columns) + 1
    vector = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    grams = packed_grams(df.select(*keys, vector.alias("v")), keys, "v")

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                _, mean, cov = moments(unpack(record["gram"], width))
                deviation = np.sqrt(np.maximum(np.diag(cov), 0.0))
                flat = deviation <= 1e-9 * np.maximum(np.abs(mean), 1.0)
                deviation[flat] = 1.0
                corr = cov / np.outer(deviation, deviation)
                corr[flat, :] = corr[:, flat] = 0.0
                _, vectors = np.linalg.eigh(corr)
                for c in range(min(components, len(columns))):
                    w = vectors[:, -1 - c]
                    w = w * np.sign(w[np.round(np.abs(w), 9).argmax()]) / deviation
                    rows.append({**{k: record[k] for k in keys}, "component": c, "shift": -float(mean @ w), "weights": w})
            if rows:
                yield pd.DataFrame(rows)

    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["component int, shift double, weights array<double>"])
    return grams.mapInPandas(decompose, schema)


def _with_models(df: DataFrame, keys: list[str], columns: list[str], components: int, keep=()) -> DataFrame:
    """Rows (keys, keep, columns as ``_x``) with the loadings ``_model`` of their key in order of the components."""
    models = loadings(df, keys, columns, components)
    packed = models.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", "shift", "weights"))).alias("_model"))
    rows = df.select(*keys, *keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    return join_groups(rows, packed, keys, "inner") if keys else rows.withColumn("_model", packed.scalar())


def _score(model: str, columns: list[str]) -> str:
    return " + ".join([f"{model}.shift", *[f"{model}.weights[{i}] * _x{i}" for i in range(len(columns))]])


def project(df: DataFrame, keys: list[str], columns: list[str], components: int, keep=()) -> DataFrame:
    """Rows as (keys, keep, component, score).  The loadings have one row per key and component."""
    joined = _with_models(df, keys, columns, components, keep)
    return joined.withColumn("_m", F.explode("_model")).selectExpr(
        *keys, *keep, "_m.component AS component", f"{_score('_m', columns)} AS score"
    )


def pca_metafeatures(df: DataFrame, features: list[str], label: str, key: str = "dataset", components: int = 3) -> DataFrame:
    """Minimum, maximum, mean, population deviation and median of the first components of features and label.

    The scores of a row are stored side by side, so that the rows don't multiply before their moments are taken.
    """
    columns = [*features, label]
    joined = _with_models(df, [key], columns, components)
    scores = materialize(joined.selectExpr(f"`{key}`", *[f"{_score(f'get(_model, {c})', columns)} AS _s{c}" for c in range(components)]))
    simple = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    spread = scores.groupBy(key).agg(*[f(f"_s{c}").alias(f"{c}_{n}") for c in range(components) for n, f in simple.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"_s{c}").alias("score")) for c in range(components)])
    found = stored_quantiles(scores.select(key, F.inline(cells)), [key, "component"], "score", [0.5], "median")
    medians = found.groupBy(key).agg(*[
        F.max(F.when(F.col("component") == c, F.col("median")[0])).alias(f"{c}_median") for c in range(components)
    ])
    return join_groups(spread, medians, [key], "inner").select(key, *[f"{c}_{n}" for c in range(components) for n in (*simple, "median")])
