"""Bounds below distances, the nearest rows found with them, and joins in several blocks and sides, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from gaugewright.operators import closest as C
from gaugewright.operators import neighbours as NB


@pytest.mark.parametrize("p", [1, 2, 3, 4, 5])
def test_bounds_are_below_the_power(p):
    t = np.linspace(0, 60, 600_001)
    bound = C.bound_of(p)
    below = bound.base + bound.square * t * t + sum(c * np.cos(w * t) for c, w in bound.waves)
    assert (below <= t**p + 1e-9).all()


def brute(query, donor, ids, k, p):
    dist = np.round((np.abs(query[:, None] - donor) ** p).sum(axis=2) ** (1 / p), 9)
    order = np.argsort(ids, kind="stable")
    return [[ids[i] for i in order[np.argsort(d[order], kind="stable")[:k]]] for d in dist]


def found(query, donor, ids, k, p, many=500):
    best = C.Closest(query, k, p, np.full(len(query), np.inf), donor[:64].mean(axis=0), donor[:64].std(axis=0))
    for start in range(0, len(donor), many):
        some = donor[start : start + many]
        best.feed(some, np.zeros(len(some)), pa.array(ids[start : start + many]), np.zeros(len(query)))
    best.settle()
    names = best.ids.to_pylist()
    return best, [[names[i] for i in np.flatnonzero(best.at == q)] for q in range(len(query))]


@pytest.mark.parametrize("p", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["spread", "copies", "outliers", "far away", "still"])
def test_closest_is_exact(p, kind):
    rng = np.random.default_rng(p)
    donor, query = rng.normal(size=(3000, 12)), rng.normal(size=(300, 12))
    if kind == "copies":
        donor[500:1500] = donor[7]
        query[:50] = donor[7]
    if kind == "outliers":
        donor[::50] *= 10.0 ** rng.integers(3, 9, (60, 1))
        query[::50] *= 1e7
    if kind == "far away":
        donor, query = donor + 1e6, query + 1e6
    if kind == "still":
        donor[:, 3:], query[:, 4:] = 1.5, 1.5
    ids = rng.permutation(3000).tolist()
    assert found(query, donor, ids, 20, p)[1] == brute(query, donor, ids, 20, p)


def test_few_pairs_are_measured(monkeypatch):
    rng = np.random.default_rng(0)
    donor, query = rng.normal(size=(30_000, 32)), rng.normal(size=(200, 32))
    measured, measure = [], C.Closest._measure
    monkeypatch.setattr(C.Closest, "_measure", lambda self, at, *rest: (measured.append(len(at)), measure(self, at, *rest))[1])
    for p in (1, 2, 3):
        measured.clear()
        best, _ = found(query, donor, list(range(30_000)), 10, p, 4096)
        assert sum(measured) < 0.05 * len(query) * len(donor)
        assert len(best.at) == 10 * len(query)  # a block reports k rows a query, whatever the donors


def test_ids_of_any_type_and_fewer_donors_than_wanted():
    donor, query = np.zeros((5, 2)), np.zeros((1, 2))
    assert found(query, donor, ["b", "a", None, "d", "c"], 3, 1)[1] == [[None, "a", "b"]]
    assert found(query, donor, ["b", "a"] + ["c"] * 3, 9, 2)[1] == [["a", "b", "c", "c", "c"]]


@pytest.mark.parametrize("p", [1, 3])
def test_join_in_blocks_and_sides(spark, monkeypatch, p):
    monkeypatch.setattr(NB, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(p)
    donor, query = rng.normal(size=(600, 5)), rng.normal(size=(70, 4))
    gone = donor.copy()
    gone[::10, 4] = np.nan  # donors without the wanted entry
    gone[5::100, 0] = np.nan  # and with a gap
    d = spark.createDataFrame([(f"d{i:03}", [float(v) if v == v else None for v in r]) for i, r in enumerate(gone)], "id string, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, 4, [*map(float, r)]) for i, r in enumerate(query)], "qid long, target int, vec array<double>")
    empty = spark.createDataFrame([(-1, 4, [0.0, None, 0.0, 0.0])], "qid long, target int, vec array<double>")
    rows = NB.knn_join(q.union(empty), d, 4, 6, p, cells=8, rows=40).toPandas()
    whole = np.flatnonzero(~np.isnan(gone).any(axis=1))
    want = brute(query, donor[whole, :4], [f"d{i:03}" for i in whole], 6, p)
    assert len(rows) == 6 * len(query)
    for i in range(len(query)):
        got = rows[rows["qid"] == i].sort_values("nth")
        assert got["id"].tolist() == want[i] and got["nth"].tolist() == [1, 2, 3, 4, 5, 6]
        assert got["value"].tolist() == [donor[int(x[1:]), 4] for x in want[i]]
    assert NB.knn_join(empty, d, 4, 6, p).count() == 0 and NB.knn_join(q, d.limit(0), 4, 6, p).count() == 0
