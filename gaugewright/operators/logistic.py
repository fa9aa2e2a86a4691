"""Logistic regression by Newton steps, each from sums of weighted products over the partitions.

Minimizes ``c * sum of the log losses + half the squared weights``; intercepts are free. Two classes have one weight
vector, more classes have one each (softmax). A round reads the rows once and sums loss, gradient and curvature; the
curvature has (classes * (1 + features)) ** 2 entries, which bounds the size of the model, not the number of rows. Rows
with a missing label or feature are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugewright.operators.sums import coded, matrix, vector_sum


class LogisticModel(NamedTuple):
    classes: list
    weights: np.ndarray  # (vectors, 1 + features), intercept first
    gradient: float  # largest entry of the gradient per row at the end
    rounds: int
    converged: bool


def probabilities(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each weight vector: one column for two classes (the second one's), else one per class."""
    scores = weights[:, 0] + x @ weights[:, 1:].T
    if scores.shape[1] == 1:
        return 0.5 * (1 + np.tanh(0.5 * scores))
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def loss_of(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    scores = weights[:, 0] + x @ weights[:, 1:].T
    if scores.shape[1] == 1:
        return float(np.logaddexp(0, np.where(y == 1, -scores[:, 0], scores[:, 0])).sum())
    top = scores.max(axis=1)
    return float((np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - scores[np.arange(len(y)), y]).sum())


def sums(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient (vectors, 1 + features) and curvature (of all of them) at some weights."""
    vectors, width = weights.shape
    pairs = [(a, b) for a in range(vectors) for b in range(a, vectors)]

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch.column("x")), batch.column("y").to_numpy()
        one = np.column_stack([np.ones(len(x)), x])
        p = probabilities(weights, x)
        hit = (y == 1)[:, None] if vectors == 1 else y[:, None] == np.arange(vectors)
        blocks = [one.T @ (one * (p[:, a] * ((a == b) - p[:, b]))[:, None]) for a, b in pairs]
        return np.concatenate([[loss_of(weights, x, y)], ((p - hit).T @ one).ravel(), np.ravel(blocks)])

    total = vector_sum(rows, 1 + vectors * width + len(pairs) * width * width, partial)
    gradient = total[1 : 1 + vectors * width].reshape(vectors, width)
    curvature = np.zeros((vectors, width, vectors, width))
    for (a, b), block in zip(pairs, total[1 + vectors * width :].reshape(len(pairs), width, width)):
        curvature[a, :, b, :] = block
        curvature[b, :, a, :] = block.T
    return total[0], gradient, curvature.reshape(vectors * width, vectors * width)


def logistic(df: DataFrame, x: str, label: str, c: float = 1.0, tolerance: float = 1e-9, rounds: int = 50) -> LogisticModel:
    """Newton steps with halving until no entry of the gradient exceeds ``tolerance`` per row.

    The model says whether that was reached within ``rounds``.
    """
    rows, classes = coded(df, x, label)
    first = rows.limit(1).collect()
    if not first or len(classes) < 2:
        raise ValueError("a classifier needs complete rows of two classes at least")
    n = rows.count()
    width = 1 + len(first[0]["x"])
    vectors = 1 if len(classes) == 2 else len(classes)
    free = np.ones((vectors, width))
    free[:, 0] = 0.0  # intercepts have no penalty

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, curvature = sums(rows, w)
        return c * loss + 0.5 * float((free * w * w).sum()), c * gradient + free * w, c * curvature + np.diag(free.ravel())

    weights = np.zeros((vectors, width))
    value, gradient, curvature = at(weights)
    used = 1
    while np.abs(gradient).max() > tolerance * c * n and used < rounds:
        # Equal shifts of all intercepts change nothing, so the least step of all that solve the system is taken.
        step = np.linalg.lstsq(curvature, gradient.ravel(), rcond=1e-12)[0].reshape(weights.shape)
        size = 1.0
        while used < rounds:
            found = at(weights - size * step)
            used += 1
            if found[0] <= value + 1e-12 * abs(value):
                break
            size /= 2
        weights = weights - size * step
        value, gradient, curvature = found
    reached = float(np.abs(gradient).max()) / (c * n)
    return LogisticModel(classes, weights, reached, used, reached <= tolerance)


def logistic_scores(model: LogisticModel, x: np.ndarray) -> np.ndarray:
    """One score per class; the highest is the prediction."""
    scores = model.weights[:, 0] + x @ model.weights[:, 1:].T
    return np.column_stack([np.zeros(len(x)), scores[:, 0]]) if len(model.weights) == 1 else scores
