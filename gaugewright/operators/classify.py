"""Classifiers whose training is one aggregation, and model sizes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.gram import packed_grams, unpack

BLOCK = 1 << 22  # scores that a task holds at once


class GaussianModel(NamedTuple):
    classes: list
    prior: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    epsilon: float


class LinearModel(NamedTuple):
    classes: list
    weights: np.ndarray  # (classes, 1 + features), intercept first


def class_sums(df: DataFrame, features: list[str], label: str, keys=()) -> DataFrame:
    """Count, sums and sums of squares per class: the sufficient statistics of Gaussian naive Bayes."""
    return df.groupBy(*keys, label).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{c}__m") for c in features],
        *[F.var_pop(c).alias(f"{c}__v") for c in features],
    )


def _pool(count, mean, var):
    """Mean and population variance of joined groups from those of the parts."""
    n = count.sum(axis=0)
    m = (count[..., None] * mean).sum(axis=0) / n[..., None]
    v = (count[..., None] * (var + (mean - m) ** 2)).sum(axis=0) / n[..., None]
    return n, m, v


def gaussian_from_sums(classes, count, mean, var, smoothing: float) -> GaussianModel:
    """Model from per-class statistics; the smoothing is a share of the largest feature variance."""
    _, _, overall = _pool(count, mean, var)
    epsilon = smoothing * float(overall.max())
    return GaussianModel(list(classes), count / count.sum(), mean, var + epsilon, epsilon)


def gaussian_nb(df: DataFrame, features: list[str], label: str, smoothing: float = 1e-9) -> GaussianModel:
    """The model (one row per class) lives on the driver, as models do."""
    rows = class_sums(df, features, label).orderBy(label).collect()
    mean = np.array([[r[f"{c}__m"] for c in features] for r in rows])
    var = np.array([[r[f"{c}__v"] for c in features] for r in rows])
    return gaussian_from_sums([r[label] for r in rows], np.array([r["n"] for r in rows], float), mean, var, smoothing)


def gaussian_scores(model: GaussianModel, x: np.ndarray) -> np.ndarray:
    scores = []
    for prior, mean, var in zip(model.prior, model.mean, model.variance):
        scores.append(np.log(prior) - 0.5 * np.log(2 * np.pi * var).sum() - 0.5 * ((x - mean) ** 2 / var).sum(axis=1))
    return np.column_stack(scores)


def predict(df: DataFrame, features: list[str], classes: list, scores, label_type, out: str = "pred") -> DataFrame:
    """Class with the highest score, the first of equal ones; scores of many classes come a block of rows at a time."""
    step = max(1, BLOCK // max(1, len(classes)))
    names = np.array(classes)

    @F.pandas_udf(label_type)
    def best(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        at = [scores(x[i : i + step]).argmax(axis=1) for i in range(0, len(x), step)]
        return pd.Series(names[np.concatenate(at)] if at else names[:0])

    return df.withColumn(out, best(*[F.col(c).cast("double") for c in features]))


def predict_gaussian(df: DataFrame, features: list[str], model: GaussianModel, label_type="int", out: str = "pred") -> DataFrame:
    """Most likely class; equal scores take the first class."""
    return predict(df, features, model.classes, lambda x: gaussian_scores(model, x), label_type, out)


def ridge_sums(df: DataFrame, features: list[str], label: str, keys=()) -> tuple[DataFrame, DataFrame]:
    """All that ridge needs: products of the features per key, and count and sums of the features per key and class."""
    vector = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    sums = df.groupBy(*keys, label).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"{c}__s") for c in features])
    return packed_grams(df.select(*keys, vector.alias("v")), list(keys), "v"), sums


def with_targets(gram: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Products of (1, features) with one target per class, +1 for its rows and -1 for the others."""
    inside = np.column_stack([counts, sums]).T  # of (1, features) over the rows of a class
    return 2 * inside - gram[:, :1]


def ridge_weights_of(gram: np.ndarray, targets: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge on raw features with a free intercept, one column of weights per class."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    center = targets[0] / n
    w = np.linalg.solve(gram[1:, 1:] - n * np.outer(mean, mean) + alpha * np.eye(len(mean)), targets[1:] - n * np.outer(mean, center))
    return np.vstack([center - mean @ w, w])


def ridge_classifier(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> LinearModel:
    grams, sums = ridge_sums(df, features, label)
    gram = unpack(grams.first()["gram"], 1 + len(features))
    rows = sums.orderBy(label).collect()  # the model: one row per class
    targets = with_targets(gram, np.array([r["n"] for r in rows], float), np.array([[r[f"{c}__s"] for c in features] for r in rows]))
    return LinearModel([r[label] for r in rows], ridge_weights_of(gram, targets, alpha).T)


def linear_scores(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return weights[:, 0] + x @ weights[:, 1:].T


def predict_linear(df: DataFrame, features: list[str], model: LinearModel, label_type="int", out: str = "pred") -> DataFrame:
    return predict(df, features, model.classes, lambda x: linear_scores(model.weights, x), label_type, out)


# ---------------------------------------------------------------- model sizes


def n_parameters(model) -> int:
    """Parameters of a fitted model: two numbers per tree node, else coefficients and intercepts."""
    if isinstance(model, GaussianModel):
        return len(model.prior) + 1
    if isinstance(model, LinearModel):
        return int(model.weights.size)
    if hasattr(model, "totalNumNodes"):
        return 2 * model.totalNumNodes
    if hasattr(model, "numNodes"):
        return 2 * model.numNodes
    if hasattr(model, "models"):  # one model per class
        return sum(n_parameters(m) for m in model.models)
    if hasattr(model, "coefficientMatrix"):
        return model.coefficientMatrix.numRows * model.coefficientMatrix.numCols + model.interceptVector.size
    if hasattr(model, "coefficients"):
        return model.coefficients.size + 1
    return int(model.weights.size)  # multilayer perceptron


# ---------------------------------------------------------------- random search


def search_gaussian(df: DataFrame, features: list[str], label: str, fold: str, smoothings) -> DataFrame:
    """Accuracy of every smoothing in every fold from two passes: class statistics, then scores."""
    rows = class_sums(df, features, label, [fold]).collect()  # folds x classes rows
    folds, classes = sorted({r[fold] for r in rows}), sorted({r[label] for r in rows})
    count = np.zeros((len(folds), len(classes)))
    mean = np.zeros((len(folds), len(classes), len(features)))
    var = np.zeros_like(mean)
    for r in rows:
        at = folds.index(r[fold]), classes.index(r[label])
        count[at] = r["n"]
        mean[at], var[at] = [r[f"{c}__m"] for c in features], [r[f"{c}__v"] for c in features]
    models = {}
    for i, f in enumerate(folds):
        others = np.arange(len(folds)) != i
        n, m, v = _pool(count[others], mean[others], var[others])
        seen = n > 0
        names = [c for c, s in zip(classes, seen) if s]
        models[f] = [gaussian_from_sums(names, n[seen], m[seen], v[seen], s) for s in smoothings]
    return _score_settings(df, features, label, fold, lambda f, s, x: gaussian_scores(models[f][s], x), lambda f: models[f][0].classes, len(smoothings))


def search_ridge(df: DataFrame, features: list[str], label: str, fold: str, alphas) -> DataFrame:
    """The same for ridge: one Gram matrix per fold serves all settings and all training parts."""
    packed, sums = ridge_sums(df, features, label, [fold])
    grams = {r[fold]: unpack(r["gram"], 1 + len(features)) for r in packed.collect()}
    rows = sums.collect()  # folds x classes rows
    classes = sorted({r[label] for r in rows})
    targets = {}
    for f, gram in grams.items():
        counts, inside = np.zeros(len(classes)), np.zeros((len(classes), len(features)))
        for r in rows:
            if r[fold] == f:
                at = classes.index(r[label])
                counts[at], inside[at] = r["n"], [r[f"{c}__s"] for c in features]
        targets[f] = with_targets(gram, counts, inside)
    total, every = sum(grams.values()), sum(targets.values())
    weights = {f: [ridge_weights_of(total - g, every - targets[f], a) for a in alphas] for f, g in grams.items()}

    def scores(f, s, x):
        return linear_scores(weights[f][s].T, x)

    return _score_settings(df, features, label, fold, scores, lambda f: classes, len(alphas))


def _score_settings(df, features, label, fold, scores, classes_of, n_settings) -> DataFrame:
    columns = [fold, label, *features]

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, part in batch.groupby(fold):
                x, truth = part[features].to_numpy(float), part[label].to_numpy()
                names = np.array(classes_of(f))
                hits = [int((names[scores(f, s, x).argmax(axis=1)] == truth).sum()) for s in range(n_settings)]
                yield pd.DataFrame({"fold": f, "pos": range(n_settings), "hits": hits, "n": len(part)})

    per_fold = df.select(*columns).mapInPandas(evaluate, "fold int, pos int, hits long, n long").groupBy("fold", "pos").agg(
        (F.sum("hits") / F.sum("n")).alias("score")
    )
    return per_fold.groupBy("pos").agg(
        F.avg("score").alias("mean_test_score"), F.stddev_pop("score").alias("std_test_score")
    )
