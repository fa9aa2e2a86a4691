"""Distributed operators against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.operators import neighbours as NB
from gaugewright.operators.folds import balance, group_kfold
from gaugewright.operators.metafeatures import feature_moments, statistical
from gaugewright.operators.pca import pca_metafeatures
from gaugewright.operators.pooling import pair_pooling
from gaugewright.operators.prep import train_test_split
from gaugewright.operators.quantiles import exact_quantiles, value_bucket
from gaugewright.operators.ranking import ordered_rank
from gaugewright.operators.search import average_rank, best_params, min_rank


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    parts = {
        "hot": rng.normal(size=3000) * 10.0 ** rng.integers(-6, 6, 3000), "equal": np.full(500, 0.25),
        "one": np.array([3.0]), "two": np.array([-1.0, 2.0]), "ties": rng.integers(0, 3, 1000).astype(float),
        "wide": np.array([-1e300, -5e-324, 0.0, 5e-324, 1e300, float("inf")]),
    }
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, vs in parts.items() for v in vs], columns=["k", "v"]))
    probs = [0.8, 0.6, 0.5, 0.4, 0.2, 0.0]
    found = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, vs in parts.items():
        if k == "wide":
            assert found[k][-1] == -1e300
        else:
            assert np.allclose(found[k], np.quantile(vs, probs), rtol=1e-12, atol=0), k
    everything = exact_quantiles(df.filter("k = 'hot'"), [], "v", [0.5]).first()["q"][0]
    assert everything == pytest.approx(np.median(parts["hot"]), rel=1e-12)


def test_buckets_keep_order(spark):
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), [0.0, float("inf"), -float("inf"), 5e-324]]))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    buckets = df.select("v", F.expr(value_bucket("v")).alias("b")).toPandas().sort_values("v")["b"].to_numpy()
    assert (np.diff(buckets) >= 0).all()


def test_ordered_rank_spreads_a_hot_key(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.8, "hot", "cold"), "v": rng.permutation(4000)})
    ranked = ordered_rank(spark.createDataFrame(frame), ["k"], ["v"]).toPandas()
    want = frame.assign(rank=frame.groupby("k")["v"].rank().astype(int) - 1, group_size=frame.groupby("k")["v"].transform("size"))
    merged = ranked.merge(want, on=["k", "v"])
    assert (merged["rank_x"] == merged["rank_y"]).all() and (merged["group_size_x"] == merged["group_size_y"]).all()


def greedy(sizes, k):
    loads, folds = [0] * k, []
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        folds.append(f)
    return folds


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 6))
def test_balance_is_greedy(sizes, k):
    sizes = sorted(sizes, reverse=True)
    counts = {s: sizes.count(s) for s in set(sizes)}
    phases = balance(list(counts.items()), k)
    folds = []
    for size in sorted(counts, reverse=True):
        for position in range(counts[size]):
            (fold,) = [turn[(position - a) % len(turn)] for s, a, b, turn in phases if s == size and a <= position < b]
            folds.append(fold)
    assert folds == greedy(sizes, k)


def test_group_kfold_per_key(spark):
    rows = [(m, f"g{g}") for m, shift in (("a", 0), ("b", 3)) for g in range(9) for _ in range((g + shift) % 4 + 1)]
    found = group_kfold(spark.createDataFrame(rows, "model string, name string"), "name", 3, ["model"]).toPandas()
    for _, part in found.groupby("model"):
        part = part.sort_values(["n", "name"], ascending=False)
        assert part["fold"].tolist() == greedy(part["n"].tolist(), 3)


def test_split_takes_a_quarter(spark):
    split = train_test_split(spark.range(1001), "id")
    assert split.filter("is_test").count() == 251
    again = train_test_split(spark.range(1001).repartition(5), "id")
    assert split.join(again.withColumnRenamed("is_test", "t"), "id").filter("is_test <> t").count() == 0


@pytest.mark.parametrize("p,chunk", [(1, 37), (2, 2048), (3, 50)])
def test_knn_join_is_exact(spark, p, chunk):
    rng = np.random.default_rng(p)
    centers = rng.normal(size=(6, 3)) * 20
    donors = centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 3))
    donors[:150] = donors[0]  # a hot spot of copies
    queries = centers[rng.integers(0, 6, 60)] + rng.normal(size=(60, 3))
    d = spark.createDataFrame([(i, [*map(float, r), float(i)]) for i, r in enumerate(donors)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, 3, [*map(float, r)]) for i, r in enumerate(queries)], "qid long, target int, vec array<double>")
    found = NB.knn_join(q, d, 3, 7, p, cells=8, rows=chunk).toPandas()
    for i, r in enumerate(queries):
        dist = np.round((np.abs(donors - r) ** p).sum(axis=1) ** (1 / p), 9)
        want = np.lexsort((np.arange(400), dist))[:7]
        got = found[found["qid"] == i].sort_values(["dist", "id"])["id"].tolist()
        assert got == want.tolist()


def brute_impute(x, k):
    filled = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        dist = np.round(NB.nan_euclidean(x[i : i + 1], x)[0], 9)
        ok = ~np.isnan(x[:, j]) & ~np.isnan(dist)
        order = [r for r in np.lexsort((np.arange(len(x)), dist)) if ok[r]][:k]
        filled[i, j] = x[order, j].mean() if order else np.nanmean(x[:, j])
    return filled


@pytest.mark.parametrize("whole", [True, False])
def test_knn_impute_is_exact(spark, whole):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 100, 5, 1]
    x[rng.random(x.shape) < 0.15] = np.nan
    if whole:
        x[:, 1] = rng.normal(size=300) * 100
    x[np.isnan(x).all(axis=1)] = 0.0
    columns = list("abcd")
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = NB.knn_impute(df, "id", columns, k=10, cells=16, rows=20).orderBy("id").toPandas()[columns].to_numpy()
    assert np.allclose(got, brute_impute(x, 10), atol=1e-9)


def test_few_donors_use_all(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 4.0), (3, 9.0, 8.0)], "id long, a double, b double")
    assert NB.knn_impute(df, "id", ["a", "b"], k=10).filter("id = 1").first()["b"] == 6.0


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_closest_rows_measure_what_can_be_near(p, offset):
    """Copies, equal distances and numbers far from zero, against all distances."""
    rng = np.random.default_rng(p)
    donor = np.round(rng.normal(size=(300, 5)), 1) + offset
    donor[200:260] = donor[7]
    query = np.vstack([np.round(rng.normal(size=(40, 5)), 1) + offset, donor[5:9]])
    at, near, dist = NB.closest_rows(query, donor, 9, p)
    whole = np.round(NB.minkowski(p)(query, donor), 9)
    want = np.argsort(whole, axis=1, kind="stable")[:, :9]
    assert np.array_equal(near.reshape(44, 9), want) and np.array_equal(at, np.repeat(np.arange(44), 9))
    assert np.array_equal(dist.reshape(44, 9), np.take_along_axis(whole, want, axis=1))


def test_chunks_report_k_rows_a_group(spark):
    """A query that visits all cells of a group reaches it once; missing numbers and targets take no part."""
    rng = np.random.default_rng(3)
    donor = rng.normal(size=(400, 3))
    rows = [(i, [*map(float, v), float("nan") if i % 5 == 0 else 1.0], i % 8) for i, v in enumerate(donor)] + [(900, [float("nan"), 0.0, 0.0, 1.0], 1)]
    queries = [(i, 3, [*map(float, v)], list(range(8)) if i % 2 else [0, 5]) for i, v in enumerate(rng.normal(size=(30, 3)))]
    d = spark.createDataFrame(rows, "id int, vec array<double>, cell int")
    q = spark.createDataFrame(queries, "qid int, target int, vec array<double>, cells array<int>")
    assert NB.candidates(q, d, 3, 4, 2, per=4).count() == 30 * 2 * 4
    found = NB.nearest(q, d, 3, 4, 2, per=4).orderBy("qid", "dist").collect()
    for i, _, vec, cells in queries:
        far = sorted((round(float(np.linalg.norm(np.subtract(vec, r[1][:3]))), 9), r[0]) for r in rows[:400] if r[0] % 5 and r[2] in cells)
        assert [r["id"] for r in found if r["qid"] == i] == [n for _, n in far[:4]]


def test_constants_have_no_shape(spark):
    """Means merged from parts can differ in the last bit; a constant still has no skewness."""
    for rows, parts in ((1000, 7), (1000, 3), (10007, 3)):
        df = spark.range(0, rows, 1, parts).select(F.lit("d").alias("dataset"), F.lit(7.0).alias("a"))
        found = feature_moments(df, ["a"]).first()
        assert (found["skewness"], found["kurtosis"], found["min"], found["max"]) == (None, None, 7.0, 7.0)


def test_statistical_metafeatures(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=90), rng.exponential(size=90), (rng.random(90) < 0.3).astype(float), np.full(90, 7.0)])
    y = rng.integers(0, 3, 90)
    df = spark.createDataFrame([("d", *map(float, r), int(c)) for r, c in zip(x, y)], "dataset string, a double, b double, c double, e double, y int")
    got = statistical(df, list("abce"), "y").first().asDict()
    numeric = x[:, [0, 1, 3]]
    _, freqs = np.unique(y, return_counts=True)
    assert got["n_num"] == 3 and got["n_onehot"] == 1 and got["n_classes"] == 3
    assert got["class_freq_std"] == pytest.approx(freqs.std())
    assert got["num_onehot_ratio"] == pytest.approx(3 / 1 / 4)
    assert got["onehot_bal_mean"] == pytest.approx(x[:, 2].mean()) and got["onehot_bal_std"] == 0
    assert got["mean_mean"] == pytest.approx(numeric.mean(axis=0).mean())
    assert got["variance_std"] == pytest.approx(numeric.var(axis=0, ddof=1).std())
    z = (numeric[:, :2] - numeric[:, :2].mean(axis=0)) / numeric[:, :2].std(axis=0)
    assert got["skewness_mean"] == pytest.approx((z**3).mean(axis=0).mean())
    assert got["kurtosis_mean"] == pytest.approx(((z**4).mean(axis=0) - 3).mean())
    no_onehot = statistical(df, list("ab"), "y").first()
    assert no_onehot["num_onehot_ratio"] == 1 and no_onehot["onehot_bal_mean"] is None


def test_pca_metafeatures(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    y = rng.integers(0, 2, 120).astype(float)
    df = spark.createDataFrame([("d", *map(float, r), float(c)) for r, c in zip(x, y)], "dataset string, a double, b double, c double, d double, y double")
    got = pca_metafeatures(df, list("abcd"), "y").first()
    data = np.column_stack([x, y])
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    for c in range(3):
        v = vt[c] * np.sign(vt[c][np.abs(vt[c]).argmax()])
        s = z @ v
        for name, f in (("min", np.min), ("max", np.max), ("mean", np.mean), ("std", np.std), ("median", np.median)):
            assert got[f"{c}_{name}"] == pytest.approx(f(s), abs=1e-8)


def test_pooling_of_everything_is_the_plain_mean(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(i, "d", *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, dataset string, a double, b double, c double, y int")
    got = pair_pooling(df, "id", list("abc"), "y", draws=3).first()
    onehot = np.eye(2)[y]
    assert got["mean_x"] == pytest.approx(x.mean()) and got["mean_y"] == pytest.approx(0.5)
    assert got["mean_xy"] == pytest.approx(np.mean([(x[:, f] * onehot[:, c]).mean() for f in range(3) for c in range(2)]))
    few = pair_pooling(df, "id", list("abc"), "y", draws=3, rows=10, n_features=2, n_classes=1).first()
    assert few["mean_x"] != pytest.approx(x.mean())


def search(spark, scores):
    rows = [("d", "m", i, f"p{i}", s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "dataset string, method string, pos int, params string, mean_test_score double")


def test_search_ranks(spark):
    equal = average_rank(search(spark, [0.9280632411067193] * 8)).orderBy("pos")
    assert [r["rank_test_score"] for r in equal.collect()] == [4] * 8
    mixed = search(spark, [0.5, float("nan"), 0.7, 0.5, None])
    assert [r["rank_test_score"] for r in average_rank(mixed).orderBy("pos").collect()] == [2, 4, 1, 2, 4]
    assert [r["rank_test_score"] for r in min_rank(mixed).orderBy("pos").collect()] == [2, 4, 1, 2, 4]
    assert best_params(average_rank(mixed)).first()["params"] == "p2"
