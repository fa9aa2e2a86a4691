"""Resumable search: a cut run equals a whole one, impossible fits are NaN, scores equal fits made by hand."""

import json
import math

import numpy as np
import pytest

from gaugewright.operators import tuning
from gaugewright.operators.logistic import logistic, logistic_scores
from gaugewright.operators.search import average_rank
from gaugewright.operators.tuning import METHODS, Method, finished, search, stratified_folds

from test_fitting import SCHEMA, points

SMALL = {
    "kNN": {"n_neighbors": [3, 5000], "p": [1]},
    "GNB": {"var_smoothing": [1e-5, 1e-9]},
    "RR": {"alpha": [0.1, 5.0]},
    "LR": {"penalty": ["l2"], "C": [0.5]},
    "SGD": {"loss": ["hinge"], "penalty": ["l2"], "alpha": [0.05]},
    "RF": {"n_estimators": [4], "criterion": ["gini"], "max_depth": [3], "max_features": ["sqrt", 20]},
    "MLP": {"hidden_layer_sizes": [(4,)], "solver": ["lbfgs"], "alpha": [0.1], "learning_rate_init": [0.1], "max_iter": [12]},
}


@pytest.fixture(scope="module")
def rows(spark):
    gaps = [(900, None, "a", "", ""), (901, [1.0, None, 0.0], "b", "", ""), (903, [0.0, 0.0, 0.0], None, "", ""), (None, [0.0, 0.0, 0.0], "a", "", "")]
    return spark.createDataFrame(points(90) + gaps, SCHEMA)


def small(*names):
    return {n: METHODS[n]._replace(grid=SMALL[n]) for n in names or SMALL}


def values(found):
    return {(r["method"], r["pos"], r["params"]): (r["mean_test_score"], r["std_test_score"]) for r in found.collect()}


def test_folds_are_balanced_within_labels(rows):
    dealt = stratified_folds(rows, "id", "x", "label", 5, 42)
    counts = {(r["label"], r["fold"]): r["count"] for r in dealt.groupBy("label", "fold").count().collect()}
    assert sum(counts.values()) == 90
    for label in "abc":
        mine = [counts.get((label, f), 0) for f in range(5)]
        assert max(mine) - min(mine) <= 1


def test_all_methods_and_impossible_fits(rows, tmp_path):
    found = search(rows, "x", "label", "id", str(tmp_path / "s"), "d", small(), folds=2)
    got = values(found)
    assert len(got) == sum(math.prod(map(len, g.values())) for g in SMALL.values())
    for (method, _, params), (mean, _) in got.items():
        s = json.loads(params)
        impossible = s.get("n_neighbors") == 5000 or s.get("max_features") == 20
        assert math.isnan(mean) == impossible, (method, params)
        assert impossible or mean > 0.5, (method, params)
    reasons = {r["reason"] for r in finished(rows.sparkSession, str(tmp_path / "s")).filter("isnan(score)").collect()}
    assert any("5000 neighbours" in r for r in reasons) and any("20 features" in r for r in reasons)
    ranks = {json.loads(r["params"])["n_neighbors"]: r["rank_test_score"] for r in average_rank(found).filter("method = 'kNN'").collect()}
    assert ranks == {3: 1, 5000: 2}
    fitted = stratified_folds(rows, "id", "x", "label", 2, 42).toPandas()
    by_hand = []
    for f in range(2):
        train, test = fitted[fitted.fold != f], fitted[fitted.fold == f]
        model = logistic(rows.sparkSession.createDataFrame(train[["x", "label"]]), "x", "label", c=0.5)
        best = logistic_scores(model, np.stack(test.x)).argmax(axis=1)
        by_hand.append(np.mean(np.array(model.classes)[best] == test.label))
    mean, std = next(v for k, v in got.items() if k[0] == "LR")
    assert mean == pytest.approx(np.mean(by_hand)) and std == pytest.approx(np.std(by_hand))


def test_cut_run_equals_whole_run(rows, tmp_path):
    fits = []

    def counted(lost_at):
        def fit(part, settings):
            fits.append(len(settings))
            if len(fits) == lost_at:
                raise RuntimeError("executor lost")  # not a fit that is impossible
            return tuning.fit_gaussian(part, settings)

        return {"GNB": Method(SMALL["GNB"], fit, lambda s: 0)}

    store = str(tmp_path / "cut")
    with pytest.raises(RuntimeError):
        search(rows, "x", "label", "id", store, "d", counted(3), folds=4, parallel=1)
    kept = finished(rows.sparkSession, store).count()
    assert 0 < kept < 8
    begun = len(fits)
    cut = search(rows, "x", "label", "id", store, "d", counted(0), folds=4, parallel=1)
    assert (len(fits) - begun) * 2 == 8 - kept
    whole = search(rows.repartition(5), "x", "label", "id", str(tmp_path / "whole"), "d", small("GNB"), folds=4)
    assert values(cut) == values(whole)
    begun = len(fits)
    again = search(rows, "x", "label", "id", store, "d", counted(0), folds=4)
    assert len(fits) == begun and values(again) == values(whole)


def test_budget_stops_and_data_sets_stay_apart(rows, tmp_path):
    store = str(tmp_path / "s")
    assert search(rows, "x", "label", "id", store, "d", small("GNB"), folds=2, budget=-1).count() == 0
    assert search(rows, "x", "label", "id", store, "d", small("GNB"), folds=2).count() == 2
    assert search(rows, "x", "label", "id", store, "other", small("GNB"), folds=2, budget=-1).count() == 0


def test_nothing_to_learn_from(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    got = values(search(empty, "x", "label", "id", str(tmp_path / "e"), "d", small("GNB"), folds=2))
    assert len(got) == 2 and all(math.isnan(m) for m, _ in got.values())
