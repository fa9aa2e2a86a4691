"""Classifiers fitted by passes of sums: optimality, gaps, and independence of the partitioning."""

import math
import random

import numpy as np
import pytest

from gaugewright.operators.descent import LOSSES, linear_sgd, slope
from gaugewright.operators.forest import forest_scores, poisson_limits, random_forest
from gaugewright.operators.logistic import logistic, logistic_scores, probabilities
from gaugewright.operators.perceptron import first_weights, loss_and_gradient, perceptron, perceptron_scores
from gaugewright.operators.sums import classified

SCHEMA = "id long, x array<double>, label string, y string, w string"


def points(n=240, classes=3, seed=1):
    rng = random.Random(seed)
    centers = [(0.0, 0.0, 1.0), (2.0, 1.0, 0.0), (0.0, 2.5, 0.5)]
    rows = []
    for i in range(n):
        c = rng.randrange(classes)
        rows.append((i, [rng.gauss(m, 0.8) for m in centers[c]], "abc"[c], "clash", "clash"))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    gaps = [(900, None, "a", "", ""), (901, [1.0, None, 0.0], "b", "", ""), (902, [1.0, math.nan, 0.0], "b", "", ""), (903, [0.0, 0.0, 0.0], None, "", "")]
    return spark.createDataFrame(points() + gaps, SCHEMA)


def arrays(classes=3):
    data = points(classes=classes)
    return np.array([r[1] for r in data]), np.array(["abc".index(r[2]) for r in data])


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_gradient_vanishes(spark, classes):
    df = spark.createDataFrame(points(classes=classes), SCHEMA)
    model = logistic(df, "x", "label", c=0.7)
    x, y = arrays(classes)
    one = np.column_stack([np.ones(len(x)), x])
    p = probabilities(model.weights, x)
    hit = (y == 1)[:, None] if classes == 2 else y[:, None] == np.arange(3)
    free = np.r_[0.0, np.ones(3)]
    assert model.converged and len(model.weights) == (1 if classes == 2 else 3)
    assert np.abs(0.7 * (p - hit).T @ one + model.weights * free).max() < 1e-6
    assert (logistic_scores(model, x).argmax(axis=1) == y).mean() > 0.8


def test_logistic_rounds_are_reported(rows):
    model = logistic(rows, "x", "label", rounds=2)
    assert not model.converged and model.rounds == 2 and model.gradient > 0


def test_same_for_any_partitioning(rows):
    one, many = rows.repartition(1), rows.repartition(7)
    assert np.allclose(logistic(one, "x", "label").weights, logistic(many, "x", "label").weights, atol=1e-9)
    a, b = (linear_sgd(d, "x", "label", "id", passes=2, chain_rows=50).weights for d in (one, many))
    assert np.allclose(a, b, atol=1e-12)
    a, b = (random_forest(d, "x", "label", "id", trees=6, depth=4) for d in (one, many))
    assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.share, b.share)


def test_descent_is_plain_descent_in_one_chain(spark):
    """All rows in one chain: steps in the order of the hash, written out."""
    import hashlib

    data = points(60, 2)
    model = linear_sgd(spark.createDataFrame(data, SCHEMA), "x", "label", "id", "log_loss", alpha=0.01, rate=0.3, passes=2)
    order = sorted(data, key=lambda r: int(hashlib.md5(f"{r[0]}-42".encode()).hexdigest()[:13], 16))
    w, t = np.zeros((2, 4)), 0
    for _ in range(2):
        for _, x, label, _, _ in order:
            eta = 0.3 / (1 + 0.01 * 0.3 * t)
            for k in range(2):
                target = 1 if label == "ab"[k] else -1
                pull = -target / (1 + math.exp(target * (w[k, 0] + w[k, 1:] @ x)))
                w[k, 1:] = w[k, 1:] * (1 - eta * 0.01) - eta * pull * np.array(x)
                w[k, 0] -= eta * pull
            t += 1
    assert np.allclose(model.weights, w, atol=1e-12)


@pytest.mark.parametrize("loss", LOSSES)
def test_losses_learn(rows, loss):
    model = linear_sgd(rows, "x", "label", "id", loss, rate=0.05, penalty="elasticnet")
    x, y = arrays()
    assert ((model.weights[:, 0] + x @ model.weights[:, 1:].T).argmax(axis=1) == y).mean() > 0.7


def test_unknown_loss():
    with pytest.raises(ValueError):
        slope("cubic", np.zeros(1))


def best_split(x, y, w, bins):
    """Every cut of every feature at its quantiles, one after the other."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], [i / bins for i in range(1, bins)]))
        for b, cut in enumerate(cuts):
            gain = 0.0
            for part, sign in ((np.ones(len(x), bool), 1), (x[:, f] <= cut, -1), (x[:, f] > cut, -1)):
                n = w[part].sum()
                if n == 0:
                    break
                gain += sign * (n - sum(w[part & (y == k)].sum() ** 2 for k in range(3)) / n)
            else:
                gain = round(gain / w.sum(), 9)
                if gain > best[0]:
                    best = (gain, f, b)
    return best[1:]


def test_forest_roots_by_brute_force(rows):
    import hashlib

    model = random_forest(rows, "x", "label", "id", trees=5, depth=3, features=3, bins=8)
    x, y = arrays()
    limits = poisson_limits()
    for t in range(5):
        place = [int(hashlib.md5(f"{i}-{t}-42".encode()).hexdigest()[:13], 16) for i in range(len(x))]
        w = np.array([sum(p >= limit for limit in limits) for p in place], float)
        assert (model.feature[t, 1], model.bin[t, 1]) == best_split(x, y, w, 8)
        share = np.array([w[y == k].sum() for k in range(3)]) / w.sum()
        assert np.allclose(model.share[t, 1], share)
    assert (forest_scores(model, x).argmax(axis=1) == y).mean() > 0.8
    nodes = (model.share.sum(axis=2) > 0).sum()
    assert model.n_parameters() == 2 * nodes and (model.feature >= 0).sum() * 2 + 5 == nodes


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_forest_of_one_class_or_no_depth(spark, criterion):
    one = spark.createDataFrame([(i, [float(i)], "a", "", "") for i in range(9)], SCHEMA)
    model = random_forest(one, "x", "label", "id", trees=3, depth=2, criterion=criterion)
    assert (model.feature < 0).all()
    two = spark.createDataFrame(points(90, 2), SCHEMA)
    model = random_forest(two, "x", "label", "id", trees=3, depth=1, criterion=criterion)
    assert (model.feature[:, 1] >= 0).all() and (model.feature[:, 2:] < 0).all()


def test_perceptron_gradient_is_the_difference_quotient():
    rng = np.random.default_rng(2)
    sizes = (3, 4, 2, 3)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 3, 20)
    w = first_weights(sizes) + 0.05
    for activation in ("tanh", "relu"):
        exact = loss_and_gradient(w, sizes, x, y, activation)[1:]
        for i in range(len(w)):
            step = np.zeros(len(w))
            step[i] = 1e-6
            up, down = (loss_and_gradient(w + s, sizes, x, y, activation)[0] for s in (step, -step))
            assert abs((up - down) / 2e-6 - exact[i]) < 1e-4


def test_perceptron_converges(rows):
    model = perceptron(rows, "x", "label", hidden=(5,), alpha=1.0, activation="tanh", tolerance=1e-4, rounds=400)
    x, y = arrays()
    assert model.converged and (perceptron_scores(model, x).argmax(axis=1) == y).mean() > 0.85


def test_predictions_of_rows_with_gaps(rows):
    model = logistic(rows, "x", "label")
    found = {r["id"]: r["pred"] for r in classified(rows, "x", model.classes, lambda x: logistic_scores(model, x), "string").collect()}
    assert found[900] is None and found[901] is None and found[902] is None and found[903] in "abc" and len(found) == 244


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for fit in (logistic, perceptron):
        with pytest.raises(ValueError):
            fit(none, "x", "label")
    for fit in (linear_sgd, random_forest):
        with pytest.raises(ValueError):
            fit(none, "x", "label", "id")
