"""Multilayer perceptrons trained on the whole of the rows: a round sums loss and gradient over the partitions.

What travels is the weights (to the tasks) and one gradient per partition (back), so a round costs one pass over the
distinct rows, however many there are: equal rows are counted once before the first round. Rows with a missing label or
feature are left out.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.sums import coded, matrix, vector_sum
from gaugewright.session import materialize


class Perceptron(NamedTuple):
    classes: list
    sizes: tuple[int, ...]  # of the layers, input and output included
    weights: np.ndarray  # of all layers in order; each layer (1 + inputs, outputs), the constants first
    activation: str
    loss: float  # at the weights, penalty included
    gradient: float  # largest entry of the gradient there
    rounds: int
    converged: bool


def layers(weights: np.ndarray, sizes) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(weights[at : at + (1 + a) * b].reshape(1 + a, b))
        at += (1 + a) * b
    return out


def first_weights(sizes, seed: int = 42) -> np.ndarray:
    """Uniform in +-sqrt(6 / (inputs + outputs)) from a multiplicative generator, constants 0."""
    state, parts = (seed * 2 + 1) % 2147483647, []
    for a, b in zip(sizes, sizes[1:]):
        bound = (6 / (a + b)) ** 0.5
        layer = np.zeros((1 + a, b))
        for i in range(1, 1 + a):
            for j in range(b):
                state = state * 48271 % 2147483647
                layer[i, j] = (2 * state / 2147483647 - 1) * bound
        parts.append(layer.ravel())
    return np.concatenate(parts)


def forward(parts: list[np.ndarray], x: np.ndarray, activation: str) -> list[np.ndarray]:
    """Values of all layers; the last has raw scores."""
    values = [x]
    for i, layer in enumerate(parts):
        z = layer[0] + values[-1] @ layer[1:]
        if i + 1 < len(parts):
            z = np.tanh(z) if activation == "tanh" else np.maximum(z, 0.0)
        values.append(z)
    return values


def loss_and_gradient(weights: np.ndarray, sizes, x: np.ndarray, y: np.ndarray, activation: str, n: np.ndarray | None = None) -> np.ndarray:
    """Sum of the softmax log losses, then its gradient; a row counts ``n`` times."""
    n = np.ones(len(y)) if n is None else n
    parts = layers(weights, sizes)
    values = forward(parts, x, activation)
    scores = values[-1]
    top = scores.max(axis=1, keepdims=True)
    p = np.exp(scores - top)
    total = p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((np.log(total[:, 0]) + top[:, 0] - scores[rows, y]) @ n)
    delta = p / total
    delta[rows, y] -= 1
    delta *= n[:, None]
    out = []
    for i in range(len(parts) - 1, -1, -1):
        out.append(np.vstack([delta.sum(axis=0), values[i].T @ delta]).ravel())
        if i:
            inner = values[i]
            delta = (delta @ parts[i][1:].T) * ((1 - inner * inner) if activation == "tanh" else inner > 0)
    return np.concatenate([[loss], *out[::-1]])


def perceptron(
    df: DataFrame, x: str, label: str, hidden=(100,), alpha: float = 1e-4, activation: str = "relu", solver: str = "lbfgs",
    rate: float = 0.1, momentum: float = 0.0, rounds: int = 200, tolerance: float = 1e-5, start: np.ndarray | None = None, seed: int = 42,
) -> Perceptron:
    """Minimizes the mean loss plus ``alpha / 2 n`` times the squared weights (constants are free).

    ``solver``: "lbfgs" (limited-memory steps with halving) or "gd" (steps of ``rate`` with ``momentum``). Ends when no entry of the
    gradient exceeds ``tolerance`` or after ``rounds`` passes; the model says which.
    """
    rows, classes = coded(df, x, label)
    shape = rows.limit(1).collect()
    if not shape:
        raise ValueError("a classifier needs complete rows")
    rows = materialize(rows.groupBy("x", "y").agg(F.count("*").alias("n")))
    n = rows.agg(F.sum("n")).first()[0]
    sizes = (len(shape[0]["x"]), *hidden, len(classes))
    weights = first_weights(sizes, seed) if start is None else np.asarray(start, float)
    penalized = np.concatenate([np.vstack([np.zeros((1, b)), np.ones((a, b))]).ravel() for a, b in zip(sizes, sizes[1:])])

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batch: pa.RecordBatch) -> np.ndarray:
            return loss_and_gradient(w, sizes, matrix(batch.column("x")), batch.column("y").to_numpy(), activation, batch.column("n").to_numpy())

        total = vector_sum(rows, 1 + len(w), partial) / n
        return total[0] + 0.5 * alpha / n * float((penalized * w * w).sum()), total[1:] + alpha / n * penalized * w

    value, gradient = at(weights)
    used, speed = 1, np.zeros_like(weights)
    memory: deque = deque(maxlen=10)
    while np.abs(gradient).max() > tolerance and used < rounds:
        if solver == "gd":
            speed = momentum * speed - rate * gradient
            weights = weights + speed
            value, gradient = at(weights)
            used += 1
            continue
        step, kept = gradient.copy(), []
        for s, d, r in reversed(memory):
            a = r * (s @ step)
            step -= a * d
            kept.append(a)
        if memory:
            s, d, _ = memory[-1]
            step *= (s @ d) / (d @ d)
        for (s, d, r), a in zip(memory, reversed(kept)):
            step += s * (a - r * (d @ step))
        if step @ gradient <= 0:
            step, memory = gradient.copy(), deque(maxlen=10)
        size = 1.0 if memory else min(1.0, 1.0 / np.abs(gradient).sum())
        while True:
            found = at(weights - size * step)
            used += 1
            if found[0] <= value - 1e-4 * size * (step @ gradient) or used >= rounds or size < 1e-12:
                break
            size /= 2
        if found[0] > value:
            break
        moved, turned = -size * step, found[1] - gradient
        if moved @ turned > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(turned):
            memory.append((moved, turned, 1 / (moved @ turned)))
        weights = weights + moved
        value, gradient = found
    largest = float(np.abs(gradient).max())
    return Perceptron(classes, sizes, weights, activation, value, largest, used, largest <= tolerance)


def perceptron_scores(model: Perceptron, x: np.ndarray) -> np.ndarray:
    return forward(layers(model.weights, model.sizes), x, model.activation)[-1]
