"""Many small regression trees at once, grown from sums per distinct feature vector.

Rows with the same key, fold and features are one cell (count, sums and sums of squares of every target), which Spark
aggregates. All trees of a key, one per left-out fold and target, are grown from its cells in one grouped pass, so their
cost follows the number of distinct feature vectors of a key (for features of data sets: data sets times environments),
not the number of rows. Cuts lie halfway between neighbouring values; the one with the largest gain in explained
squares is taken, of equal ones (in nine digits of the root's squares) the least feature, then the least value. A node
without gain is a leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 5
DIGITS = 9
TREE = "Decision Tree"


def cell_sums(df: DataFrame, keys: list[str], x: str, y: str, targets: int) -> DataFrame:
    """Cells (keys, x, n, s, q) of an array of targets."""
    entries = [F.col(y)[i] for i in range(targets)]
    return df.groupBy(*keys, F.col(x).alias("x")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in entries]).alias("s"), F.array(*[F.sum(v * v) for v in entries]).alias("q")
    )


def best_cut(x: np.ndarray, n: np.ndarray, s: np.ndarray, squares: float) -> tuple[int, float] | None:
    """Feature and threshold with the largest gain, or None."""
    order = np.argsort(x, axis=0, kind="stable")
    value = np.take_along_axis(x, order, axis=0)
    left_n, left_s = n[order].cumsum(axis=0)[:-1], s[order].cumsum(axis=0)[:-1]
    all_n, all_s = n.sum(), s.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + (all_s - left_s) ** 2 / (all_n - left_n) - all_s**2 / all_n
    gain = np.round(np.where(value[1:] > value[:-1], gain / squares, -1.0), DIGITS).T  # features first
    if not gain.size or gain.max() <= 0:
        return None
    f, at = np.unravel_index(gain.argmax(), gain.shape)
    low, high = value[at, f], value[at + 1, f]
    middle = (low + high) / 2
    return int(f), float(middle if middle < high else low)


def grow(x: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One tree for one target as (nodes, 3): feature (-1: leaf), threshold, mean; node 1 is the root, 2 i and 2 i + 1 are below i."""
    tree = np.zeros((2 ** (depth + 1), 3))
    tree[:, 0] = -1
    squares = q.sum() - s.sum() ** 2 / n.sum()
    if squares <= 1e-12 * max(q.sum(), 1e-300):  # a constant target has nothing but rounding to explain
        squares = 0.0
    waiting = [(1, np.arange(len(x)))]
    while waiting:
        node, inside = waiting.pop()
        tree[node, 2] = s[inside].sum() / n[inside].sum()
        found = best_cut(x[inside], n[inside], s[inside], squares) if squares and node < 2**depth else None
        if found:
            tree[node, :2] = found
            left = x[inside, found[0]] <= found[1]
            waiting += [(2 * node, inside[left]), (2 * node + 1, inside[~left])]
    return tree


def grow_all(x: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A tree per target: (targets, nodes, 3)."""
    return np.stack([grow(x, n, s[:, t], q[:, t], depth) for t in range(s.shape[1])])


def tree_values(trees: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Predictions (rows, targets)."""
    out = np.empty((len(x), len(trees)))
    rows = np.arange(len(x))
    for t, tree in enumerate(trees):
        node = np.ones(len(x), int)
        for _ in range(len(tree).bit_length()):
            f = tree[node, 0].astype(int)
            node = np.where(f >= 0, 2 * node + (x[rows, f] > tree[node, 1]), node)
        out[:, t] = tree[node, 2]
    return out


def fold_trees(cells: DataFrame, keys: list[str], fold: str, depth: int = DEPTH) -> DataFrame:
    """Trees ``(keys, fold, target, feature, threshold, value)`` of every left-out fold, grown from the other folds."""
    types = dict(cells.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, s, q = (np.array(table[c].to_pylist(), float).reshape(table.num_rows, -1) for c in ("x", "s", "q"))
        n, folds = table["n"].to_numpy().astype(float), table[fold].to_numpy()
        out: list[tuple] = []
        for f in np.unique(folds):
            train = folds != f
            if train.any():
                for target, tree in enumerate(grow_all(x[train], n[train], s[train], q[train], depth)):
                    out.append((f, target, tree[:, 0].astype(np.int32), tree[:, 1], tree[:, 2]))
        columns = [pa.array([k.as_py()] * len(out), k.type) for k in key]
        kinds = (table[fold].type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        columns += [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays(columns, [*keys, fold, "target", "feature", "threshold", "value"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in (*keys, fold)] + ["target int, feature array<int>, threshold array<double>, value array<double>"])
    return cells.groupBy(*keys).applyInArrow(run, schema)


def walk(x: Column, feature: Column, threshold: Column, value: Column, depth: int = DEPTH) -> Column:
    """Prediction of a tree given as arrays, node by node from the root."""
    def below(node: Column, _: Column) -> Column:
        f = F.get(feature, node)
        right = (F.get(x, f) > F.get(threshold, node)).cast("int")
        return F.when(f >= 0, 2 * node + right).otherwise(node)

    return F.get(value, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), below))
