"""Sums of products per key: all that linear models need to know about the rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HELD = 4 << 20  # numbers that a task holds before it sends matrices on


def parted(batch: pa.RecordBatch, matrix: np.ndarray, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of every key of a batch, in their order; no row is handled by itself."""
    if not keys:
        yield (), matrix
        return
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        _, codes = np.unique(codes * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield tuple(batch.column(k)[int(at[0])].as_py() for k in keys), matrix[at]


def gram_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``sum(v_i * v_j)`` per key for i <= j as rows (keys, i, j, s).

    Every partition is reduced to one matrix per key before anything is shuffled; beyond ``HELD`` numbers the
    matrices so far are sent on.
    """
    keys = list(keys)
    types = dict(df.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                i, j = np.triu_indices(len(total))
                columns = [pa.array([value] * len(i), t) for value, t in zip(key, kinds, strict=True)]
                columns += [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "i", "j", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            matrix = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for key, rows in parted(batch, matrix, keys):
                held[key] = held.get(key, 0.0) + rows.T @ rows
            if len(held) * matrix.shape[1] ** 2 > HELD:
                yield from flush()
                held.clear()
        yield from flush()

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["i int", "j int", "s double"])
    return df.select(*keys, vector).mapInArrow(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def packed_grams(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per key with the upper triangle as an array; its length is fixed by the vector width."""
    entries = F.array_sort(F.collect_list(F.struct("i", "j", "s")))
    return gram_sums(df, keys, vector).groupBy(*keys).agg(F.transform(entries, lambda e: e["s"]).alias("gram"))


def unpack(gram, width: int) -> np.ndarray:
    full = np.zeros((width, width))
    i, j = np.triu_indices(width)
    full[i, j] = full[j, i] = np.asarray(gram)
    return full


def moments(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means and population covariance; entry 0 of the vector is the constant 1."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    return n, mean, gram[1:, 1:] / n - np.outer(mean, mean)


def _shrink(value: np.ndarray, by: float) -> np.ndarray:
    return np.sign(value) * np.maximum(np.abs(value) - by, 0.0)


def settle_signs(cov: np.ndarray, target: np.ndarray, l1: float, l2: float, w: np.ndarray) -> np.ndarray:
    """Exact minimum of ``w' cov w / 2 - target' w + l1 |w| + l2 / 2 w^2`` from a weight vector near it.

    The weights with known signs solve a linear system. A sign that doesn't hold ends the step at its zero, and the zero
    weight whose gradient exceeds ``l1`` most gets a sign, until none does. Every step lowers the value, so it ends.
    """
    q = cov + l2 * np.eye(len(w))
    scale = l1 + np.abs(target).max()
    sign = np.sign(w)

    def value(v: np.ndarray) -> float:
        return 0.5 * v @ q @ v - target @ v + l1 * np.abs(v).sum()

    for _ in range(20 * len(w) + 20):
        held = np.flatnonzero(sign)
        if len(held):
            goal = np.zeros_like(w)
            goal[held] = np.linalg.lstsq(q[np.ix_(held, held)], target[held] - l1 * sign[held], rcond=1e-12)[0]
            if (goal[held] * sign[held] < 0).any():
                step = goal - w
                with np.errstate(divide="ignore", invalid="ignore"):
                    zeros = -w / step
                stops = [t for t in zeros[held] if 0 < t < 1] + [1.0]
                best = min(stops, key=lambda t: value(w + t * step))
                w = np.where(np.isclose(zeros, best, rtol=1e-12, atol=0) & (sign != 0), 0.0, w + best * step)
                sign = np.sign(w)
                continue
            w = goal
        slope = q @ w - target
        over = np.where(sign == 0, np.abs(slope) - l1, -1.0)
        if over.max() <= 1e-10 * scale:
            return w
        sign[over.argmax()] = -np.sign(slope[over.argmax()])
    warnings.warn("the signs of a sparse fit did not settle", RuntimeWarning, stacklevel=2)
    return w


def coordinate_descent(cov, target, alpha, l1, sweeps=100, tol=1e-7) -> np.ndarray:
    """Minimize half the mean squared error plus ``alpha * (l1 * |w| + (1 - l1) / 2 * w^2)``.

    Solves many problems at once: ``cov`` (problems, p, p), ``target`` (problems, p, targets), ``alpha`` and
    ``l1`` (problems,). Problems of which a weight still changes by more than ``tol`` of the largest one after ``sweeps`` are solved
    exactly from there.
    """
    w = np.zeros_like(target)
    diagonal = np.diagonal(cov, axis1=1, axis2=2)
    l1_part, l2_part = (alpha * l1)[:, None], (alpha * (1 - l1))[:, None]
    active = [j for j in range(cov.shape[1]) if (diagonal[:, j] > 0).any()]
    moved = np.zeros(w[:, 0].shape)
    for _ in range(sweeps):
        moved = np.zeros(w[:, 0].shape)
        scales = np.maximum(np.abs(w).max(axis=1), 1e-12)
        for j in active:
            own = diagonal[:, j, None]
            rest = target[:, j] - np.matmul(cov[:, j, None, :], w)[:, 0] + own * w[:, j]
            scale = own + l2_part
            new = np.where(own > 0, _shrink(rest, l1_part) / np.where(scale > 0, scale, 1.0), 0.0)
            moved = np.maximum(moved, np.abs(new - w[:, j]) / scales)
            w[:, j] = new
        if moved.max(initial=0.0) < tol:
            return w
    for i, c in zip(*np.nonzero(moved >= tol)):
        used = diagonal[i] > 0
        w[i, used, c] = settle_signs(cov[i][np.ix_(used, used)], target[i, used, c], float(l1_part[i, 0]), float(l2_part[i, 0]), w[i, used, c])
    return w


# The linear regressors to choose from, as (kind, alpha).
REGRESSORS = {
    "Linear Regression": ("linear", 0.0),
    "Ridge A1": ("ridge", 1.0), "Ridge A0.1": ("ridge", 0.1), "Ridge A00.1": ("ridge", 0.01),
    "Lasso A1": ("lasso", 1.0), "Lasso A0.1": ("lasso", 0.1), "Lasso A0.01": ("lasso", 0.01),
    "ElasticNet A1": ("elastic", 1.0), "ElasticNet A0.1": ("elastic", 0.1), "ElasticNet A0.01": ("elastic", 0.01),
}
L1_RATIO = 0.5


def fit(grams: np.ndarray, n_features: int, regressors, plain: int = 0) -> np.ndarray:
    """Coefficients ``(grams, regressors, 1 + n_features, targets)``, intercept first.

    The summed vector is (1, features, targets).  Features are standardized, except the last ``plain`` ones.
    """
    p = n_features
    parts = [moments(g) for g in grams]
    n = np.array([c for c, _, _ in parts])
    mean, cov = np.stack([m for _, m, _ in parts]), np.stack([c for _, _, c in parts])
    deviation = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2)[:, :p], 0.0))
    constant = deviation <= 1e-6 * np.maximum(np.abs(mean[:, :p]), 1.0)
    deviation = np.where(constant, 1.0, deviation)
    if plain:
        deviation[:, p - plain:] = 1.0
    moving = ~constant
    sxx = cov[:, :p, :p] / (deviation[:, :, None] * deviation[:, None, :]) * (moving[:, :, None] & moving[:, None, :])
    # a constant target has nothing but rounding to explain
    spread = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2)[:, p:], 0.0)) > 1e-6 * np.abs(mean[:, p:])
    sxy = cov[:, :p, p:] / deviation[:, :, None] * moving[:, :, None] * spread[:, None, :]
    solved = np.zeros((len(grams), len(regressors), p, sxy.shape[2]))
    sparse = [i for i, (kind, _) in enumerate(regressors) if kind in ("lasso", "elastic")]
    for i, (kind, alpha) in enumerate(regressors):
        if kind == "linear":
            solved[:, i] = np.linalg.pinv(sxx, rcond=1e-9, hermitian=True) @ sxy
        elif kind == "ridge":
            solved[:, i] = np.linalg.solve(sxx * n[:, None, None] + alpha * np.eye(p), sxy * n[:, None, None])
    if sparse:
        # Differences of sums leave small negative eigenvalues and targets outside the range, along which descent drifts.
        values, vectors = np.linalg.eigh(sxx)
        kept = np.where(values > 1e-7 * values[:, -1:], 1.0, 0.0)
        back = np.swapaxes(vectors, 1, 2)
        sxx = np.matmul(vectors * (values * kept)[:, None, :], back)
        sxy = np.matmul(vectors * kept[:, None, :], np.matmul(back, sxy))
        alphas = np.tile([regressors[i][1] for i in sparse], len(grams))
        l1 = np.tile([1.0 if regressors[i][0] == "lasso" else L1_RATIO for i in sparse], len(grams))
        found = coordinate_descent(np.repeat(sxx, len(sparse), axis=0), np.repeat(sxy, len(sparse), axis=0), alphas, l1)
        solved[:, sparse] = found.reshape(len(grams), len(sparse), *found.shape[1:])
    solved = solved / deviation[:, None, :, None]
    intercept = mean[:, None, p:] - np.einsum("gp,grpt->grt", mean[:, :p], solved)
    return np.concatenate([intercept[:, :, None, :], solved], axis=2)


def fit_linear(df: DataFrame, keys: list[str], features: list[str], target: str, regressors=None) -> DataFrame:
    """Intercept and slopes of each regressor per key: ``(keys, regr, intercept, coefficients)``."""
    chosen = {r: REGRESSORS[r] for r in (regressors or REGRESSORS)}
    width = len(features) + 2
    vector = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)])
    grams = packed_grams(df.select(*keys, vector.alias("v")), keys, "v")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                gram = unpack(record["gram"], width)
                weights = fit(gram[None], len(features), list(chosen.values()))[0, :, :, 0]
                for name, w in zip(chosen, weights):
                    rows.append({**{k: record[k] for k in keys}, "regr": name, "intercept": w[0], "coefficients": w[1:]})
            if rows:
                yield pd.DataFrame(rows)

    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["regr string, intercept double, coefficients array<double>"])
    return grams.mapInPandas(solve, schema)
