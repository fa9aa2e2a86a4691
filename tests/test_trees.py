"""Regression trees from sums, and sparse fits solved to the end."""

import random

import numpy as np
from pyspark.sql import functions as F

from gaugewright.operators.gram import coordinate_descent, settle_signs
from gaugewright.operators.trees import cell_sums, fold_trees, grow, tree_values, walk


def plain_tree(x, y, depth, squares, node=1):
    """Every cut of every feature, one after the other: {node: (feature, threshold) or mean}."""
    best = (0.0, None)
    if depth and squares > 0:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= a
                gain = round((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)) / squares, 9)
                if gain > best[0]:
                    best = (gain, (f, (a + b) / 2))
    if best[1] is None:
        return {node: y.mean()}
    f, cut = best[1]
    left = x[:, f] <= cut
    return {node: best[1], **plain_tree(x[left], y[left], depth - 1, squares, 2 * node), **plain_tree(x[~left], y[~left], depth - 1, squares, 2 * node + 1)}


def test_like_a_plain_tree():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(0, 6, (40, 3)).astype(float)
        y = np.round(x[:, 0] * (x[:, 1] > 2) + rng.normal(size=40), 3)
        want = plain_tree(x, y, 4, ((y - y.mean()) ** 2).sum())
        # cells: equal vectors together
        cells, at = np.unique(x, axis=0, return_inverse=True)
        n, s, q = (np.bincount(at.ravel(), w) for w in (np.ones(40), y, y * y))
        tree = grow(cells, n, s, q, 4)
        for node, entry in want.items():
            if isinstance(entry, tuple):
                assert (int(tree[node, 0]), tree[node, 1]) == entry
            else:
                assert tree[node, 0] == -1 and abs(tree[node, 2] - entry) < 1e-9


def test_constant_target_and_one_cell():
    tree = grow(np.array([[1.0], [2.0]]), np.array([2.0, 3.0]), np.array([2.2, 3.3]), np.array([2.42, 3.63]))
    assert (tree[:, 0] == -1).all() and abs(tree[1, 2] - 1.1) < 1e-12
    assert (grow(np.array([[1.0]]), np.array([2.0]), np.array([3.0]), np.array([9.0]))[:, 0] == -1).all()


def test_trees_per_key_and_fold(spark):
    rng = random.Random(5)
    rows = [(k, i % 3, [float(rng.randrange(5)), float(rng.randrange(4))], [float(rng.randrange(20)), 1.0]) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, fold int, x array<double>, y array<double>").repartition(4)
    trees = fold_trees(cell_sums(df, ["k", "fold"], "x", "y", 2), ["k"], "fold")
    found = {(r["k"], r["fold"], r["target"]): r for r in trees.collect()}
    assert len(found) == 3 * 3 * 2
    for (k, fold, target), r in found.items():
        part = [(x, y) for k2, f, x, y in rows if k2 == k and f != fold]
        x, y = np.array([p[0] for p in part]), np.array([p[1][target] for p in part])
        want = plain_tree(x, y, 5, ((y - y.mean()) ** 2).sum())
        tree = np.column_stack([r["feature"], r["threshold"], r["value"]])
        for node, entry in want.items():
            assert (tree[node, 0] >= 0) == isinstance(entry, tuple)
        assert np.allclose(tree_values(tree[None], x)[:, 0], [_predict(want, v) for v in x])
    one = df.filter("k = 'a'").join(trees.filter("k = 'a' AND target = 0").drop("k"), "fold")
    for r in one.select("x", "fold", walk(F.col("x"), F.col("feature"), F.col("threshold"), F.col("value")).alias("p")).collect():
        t = found["a", r["fold"], 0]
        tree = np.column_stack([t["feature"], t["threshold"], t["value"]])
        assert abs(tree_values(tree[None], np.array([r["x"]]))[0, 0] - r["p"]) < 1e-12


def _predict(tree, x, node=1):
    entry = tree[node]
    return _predict(tree, x, 2 * node + (x[entry[0]] > entry[1])) if isinstance(entry, tuple) else entry


def test_sparse_fits_meet_their_conditions():
    rng = np.random.default_rng(1)
    for trial in range(30):
        p = 12
        x = rng.normal(size=(30, p)) @ rng.normal(size=(p, p)) * rng.uniform(0.01, 3, p)  # strongly correlated
        y = x @ rng.normal(size=p) + rng.normal(size=30)
        cov, target = x.T @ x / 30, x.T @ y / 30
        for alpha, ratio in ((1.0, 1.0), (0.01, 1.0), (0.1, 0.5)):
            l1, l2 = alpha * ratio, alpha * (1 - ratio)
            for w in (settle_signs(cov, target, l1, l2, np.zeros(p)), coordinate_descent(cov[None], target[None, :, None], np.array([alpha]), np.array([ratio]), sweeps=3)[0, :, 0]):
                slope = cov @ w + l2 * w - target
                near = 1e-7 * (l1 + np.abs(target).max())
                assert (np.abs(slope[w == 0]) <= l1 + near).all()
                assert np.abs(slope[w != 0] + l1 * np.sign(w[w != 0])).max(initial=0) <= near
