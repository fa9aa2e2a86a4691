"""Whole plans: rating, meta-learning, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.meta import Property
from gaugewright.operators.gram import REGRESSORS, fit, fit_linear
from gaugewright.operators.index import idx, index_best
from gaugewright.operators.reference import index_centered, optimal_references
from gaugewright.plans.metalearn import design_table, meta_learn
from gaugewright.plans.rate import rate
from gaugewright.plans.recommend import recommend
from gaugewright.streaming import runs as streamed
from gaugewright.streaming.energy import start_energy, windowed_energy
from gaugewright.streaming.runs import compact, current_table, start_merge

PROPS = (
    Property("acc", "Accuracy", "ACC", "percent", "Performance", 0.5, True, True),
    Property("time", "Time", "T", "seconds", "Resources", 0.5),
)
SCHEMA = "configuration string, dataset string, task string, environment string, model string, acc double, time double"


def table(spark, rows):
    return spark.createDataFrame(
        [(f"{t} - {d} - {m}", d, t, e, m, None if a is None else float(a), None if s is None else float(s)) for d, t, e, m, a, s in rows], SCHEMA
    )


def example(spark):
    return table(spark, [
        ("d", "train", "e1", "A", 0.8, 2), ("d", "train", "e1", "B", 0.4, 1), ("d", "train", "e1", "C", None, 4),
        ("d", "infer", "e1", "A", None, 3), ("d", "infer", "e1", "B", None, 6), ("d", "infer", "e1", "C", None, 3),
        ("d", "train", "e2", "A", 0.9, 5), ("d", "train", "e2", "B", 0.3, 10),
    ])


def by_row(df):
    return {(r["task"], r["environment"], r["model"]): r for r in df.collect()}


def test_rating_shares_and_scores(spark):
    rated = rate(example(spark), PROPS)
    rows = by_row(rated.database)
    a = rows["train", "e1", "A"]
    assert (a[idx("acc")], a[idx("time")], a["compound_index"]) == (1.0, 0.5, 0.75)
    assert (a["quality_index"], a["resource_index"]) == (1.0, 0.5)
    # a missing value in a group that has the property: index 0, shared value where there is one
    c = rows["train", "e1", "C"]
    assert c["acc"] is None and c[idx("acc")] == 0.0 and c["compound_index"] == 0.125
    shared = rows["infer", "e1", "A"]
    assert shared["acc"] == 0.8 and shared[idx("acc")] == 1.0 and shared["compound_index"] == 1.0
    # nobody measured it: the cell stays empty and does not count
    empty = rows["infer", "e1", "C"]
    assert empty["acc"] is None and empty[idx("acc")] is None and empty["compound_index"] == 1.0 and empty["quality_index"] == 0.0
    assert {r["property"] for r in rated.boundaries.collect()} == {"acc", "time", "compound_index", "quality_index", "resource_index"}
    real = {(r["task"], r["environment"], r["property"], r["band"]): r["start"] for r in rated.real_boundaries.collect()}
    assert ("infer", "e1", "acc", 0) not in real and real["train", "e1", "time", 0] == pytest.approx(1 / 100000)


def test_rating_again_changes_nothing(spark):
    first = rate(example(spark), PROPS, {"default": [0.9, 0.8, 0.7, 0.6]}).database
    plain = by_row(first)
    independent = example(spark)
    again = by_row(rate(rate(independent, PROPS[1:]).database, PROPS[1:]).database)
    once = by_row(rate(independent, PROPS[1:]).database)
    assert again == once and plain["train", "e1", "A"]["acc__rating"] == 0


@pytest.mark.parametrize("mode", ["best", "worst", "optimistic mean", "pessimistic median"])
def test_scores_lie_between_the_indices(spark, mode):
    for r in rate(example(spark), PROPS, rating_mode=mode).database.collect():
        cells = [x for x in (r[idx("acc")], r[idx("time")]) if x is not None]
        assert min(cells) <= r["compound_index"] <= max(cells)


def test_centered_mode(spark):
    df = table(spark, [
        ("d", "t", "e1", "A", 1, 1), ("d", "t", "e1", "B", 2, 2), ("d", "t", "e1", "C", 4, 4),
        ("d", "t", "e2", "A", 1, 8), ("d", "t", "e2", "D", 2, 4),
    ])
    own = {(r["environment"]): r["reference"] for r in optimal_references(df, PROPS).collect()}
    assert own["e1"] in "ABC"
    named = spark.createDataFrame([("d", "B")], "dataset string, reference string")
    indexed, references = index_centered(df, PROPS, named)
    rows = by_row(indexed)
    assert (rows["t", "e1", "C"][idx("acc")], rows["t", "e1", "C"][idx("time")]) == (2.0, 0.5)
    assert rows["t", "e1", "B"][idx("acc")] == 1.0
    # e2 has no model B and falls back to its own reference
    assert {r["environment"]: r["reference"] for r in references.collect()}["e1"] == "B"
    assert 1.0 in (rows["t", "e2", "A"][idx("acc")], rows["t", "e2", "D"][idx("acc")])
    assert rate(df, PROPS, mode="centered").references.count() == 2
    with pytest.raises(ValueError):
        rate(df, PROPS, mode="nearest")


def test_result_does_not_depend_on_partitions(spark):
    a = rate(example(spark), PROPS).database.collect()
    b = rate(example(spark).repartition(7), PROPS).database.collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_index_plan_is_native(spark):
    plan = index_best(example(spark), PROPS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------- learning


def standardized(x):
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s == 0, 1, s)


def solve(kind, alpha, x, y):
    """Slow reference solutions on standardized rows."""
    z, c = standardized(x), y - y.mean()
    n, p = z.shape
    if kind == "linear":
        w = np.linalg.lstsq(z, c, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(z.T @ z + alpha * np.eye(p), z.T @ c)
    else:
        l1 = 1.0 if kind == "lasso" else 0.5
        w = np.zeros(p)
        step = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + alpha * (1 - l1))
        for _ in range(20000):
            g = w - step * (z.T @ (z @ w - c) / n + alpha * (1 - l1) * w)
            w = np.sign(g) * np.maximum(np.abs(g) - step * alpha * l1, 0)
    return z @ w + y.mean()


@pytest.mark.parametrize("name", list(REGRESSORS))
def test_regressors_from_sums(name):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 5)) * [1, 10, 0.1, 1, 1] + 3
    x[:, 4] = 2.0
    y = x @ rng.normal(size=5) + rng.normal(size=80)
    rows = np.column_stack([np.ones(80), x, y])
    w = fit((rows.T @ rows)[None], 5, [REGRESSORS[name]])[0, 0, :, 0]
    assert np.allclose(w[0] + x @ w[1:], solve(*REGRESSORS[name], x, y), atol=1e-5)


def test_linear_fit_per_key(spark):
    rng = np.random.default_rng(12)
    rows = [(k, float(x), s * float(x) + 1) for k, s in (("a", 2.0), ("b", -3.0)) for x in rng.normal(size=50)]
    found = fit_linear(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x"], "y", ["Linear Regression"])
    for r in found.collect():
        assert r["intercept"] == pytest.approx(1) and r["coefficients"][0] == pytest.approx({"a": 2.0, "b": -3.0}[r["k"]])


def learning_table(spark, datasets=24):
    """Two algorithms whose indices follow a feature of the data set."""
    rng = np.random.default_rng(13)
    size = rng.uniform(0, 1, datasets)
    rows = []
    for i, s in enumerate(size):
        for e in ("e1", "e2"):
            rows += [(f"d{i:02d}", "t", e, "A", 0.5 + 0.5 * s, 1 + s), (f"d{i:02d}", "t", e, "B", 1 - 0.4 * s, 2.0 - s)]
    features = spark.createDataFrame([(f"d{i:02d}", float(s), float(s**2)) for i, s in enumerate(size)], "dataset string, size double, square double")
    return table(spark, rows), features


def ENVIRONMENTS(rated):
    return sorted(r[0] for r in rated.select("environment").distinct().collect())


def test_meta_learning_finds_the_rule(spark):
    df, features = learning_table(spark)
    rated = rate(df, PROPS).database
    refs = rated.groupBy("dataset", "task", "environment").agg(F.max("acc").alias("acc__ref"), F.min("time").alias("time__ref"))
    design = design_table(rated, refs, features, PROPS, ENVIRONMENTS(rated))
    predictions, chosen = meta_learn(design, PROPS)
    out = predictions.toPandas()
    assert len(out) == df.count() * 2 * 3 and out["test_pred"].notna().all()
    assert chosen.count() == 2 * 2 * 2
    value = out[out["scale"] == "value"]
    assert value["test_err"].abs().max() < 0.05
    index = out[out["scale"] == "index"]
    assert index["test_pred"].between(0, 1).all()
    truth = index["test_pred"] - index["test_err"]
    baseline = (truth - truth.groupby([index["model"], index["property"]]).transform("mean")).abs().mean()
    assert index["test_err"].abs().mean() < baseline / 2
    # every row is predicted by models that never saw its data set: refit one fold by hand
    best = recommend(predictions.filter("scale = 'index' AND property = 'acc'").withColumn("pred", F.col("test_pred"))).toPandas()
    winners = rated.filter(f"{idx('acc')} = 1").select("dataset", "environment", "model").toPandas()
    agree = best.merge(winners, on=["dataset", "environment"])
    assert (agree["model_x"] == agree["model_y"]).mean() > 0.8


def test_feature_sets_in_one_run(spark):
    """A narrow set beside a wide one gives what it gives alone; a set that says nothing is worse."""
    from gaugewright.plans.metalearn import design_sets, split_sets

    df, features = learning_table(spark)
    rated = rate(df, PROPS).database
    refs = rated.groupBy("dataset", "task", "environment").agg(F.max("acc").alias("acc__ref"), F.min("time").alias("time__ref"))
    noise = features.select("dataset", (F.crc32("dataset") % 97).cast("double").alias("noise"))
    design = design_sets(rated, refs, {"wide": features, "narrow": noise}, PROPS, ENVIRONMENTS(rated))
    assert {r[0] for r in design.select(F.size("x")).distinct().collect()} == {1 + 2 + 1}
    found = split_sets(meta_learn(design, PROPS)[0]).toPandas()
    alone = meta_learn(design_table(rated, refs, noise, PROPS, ENVIRONMENTS(rated)), PROPS)[0].toPandas()
    assert set(found["model"]) == {"A", "B"} and set(found["feature_set"]) == {"wide", "narrow"}
    keys = ["configuration", "environment", "scale", "property"]
    both = found[found["feature_set"] == "narrow"].merge(alone, on=keys)
    assert len(both) == len(alone) and np.allclose(both["test_pred_x"], both["test_pred_y"], atol=1e-6)
    error = found[found["scale"] == "index"].groupby("feature_set")["test_err"].apply(lambda e: e.abs().mean())
    assert error["wide"] < error["narrow"] / 2


def test_meta_learning_in_many_chunks(spark, monkeypatch):
    from gaugewright.plans import metalearn
    df, features = learning_table(spark, 12)
    rated = rate(df, PROPS).database
    refs = rated.groupBy("dataset", "task", "environment").agg(F.max("acc").alias("acc__ref"), F.min("time").alias("time__ref"))
    design = design_table(rated, refs, features, PROPS, ENVIRONMENTS(rated))
    whole = meta_learn(design, PROPS)[0].toPandas()
    chunks = metalearn._chunks
    monkeypatch.setattr(metalearn, "_chunks", lambda rows, models: chunks(rows, models, 5))
    cut = meta_learn(design, PROPS)[0].toPandas()
    keys = ["configuration", "environment", "scale", "property"]
    both = whole.merge(cut, on=keys)
    assert len(both) == len(whole) and np.allclose(both["test_pred_x"], both["test_pred_y"]) and np.allclose(both["train_err_x"], both["train_err_y"])


# ---------------------------------------------------------------- streaming

RUN = "dataset string, task string, model string, architecture string, software string, log_name string, acc double"


def test_stream_merge_over_arriving_files(spark, tmp_path):
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))
    row = lambda name, model, acc: ("d", "t", model, "a", "s", name, acc)
    spark.createDataFrame([row("log2", "A", 1.0), row("log3", "B", 5.0)], RUN).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(RUN).parquet(source)
    start_merge(read(), place, checkpoint).awaitTermination()
    spark.createDataFrame([row("log1", "A", 3.0)], RUN).write.mode("append").parquet(source)
    start_merge(read(), place, checkpoint).awaitTermination()
    rows = {r["configuration"]: (r["n_results"], r["log_name"], r["acc"]) for r in current_table(spark, place).collect()}
    assert rows == {"t - d - A": (2, "log1", 2.0), "t - d - B": (1, "log3", 5.0)}


def test_stream_merge_counts_a_run_once_and_compacts(spark, tmp_path):
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))
    for rows in ([("log1", 1.0), ("log2", 2.0)], [("log2", 2.0), ("log3", 6.0)], [("log4", 3.0)]):
        data = [("d", "t", "A", "a", "s", name, acc) for name, acc in rows]
        spark.createDataFrame(data, RUN).coalesce(1).write.mode("append").parquet(source)
        start_merge(spark.readStream.schema(RUN).parquet(source), place, checkpoint).awaitTermination()
    state = lambda: [(r["n_results"], r["log_name"], r["acc"]) for r in current_table(spark, place).collect()]
    assert state() == [(4, "log1", 3.0)]
    assert compact(spark, place) == 2 and compact(spark, place) == 2
    assert state() == [(4, "log1", 3.0)]
    spark.createDataFrame([("d", "t", "A", "a", "s", "log1", 9.0), ("d", "t", "A", "a", "s", "log5", 8.0)], RUN).write.mode("append").parquet(source)
    start_merge(spark.readStream.schema(RUN).parquet(source), place, checkpoint).awaitTermination()
    assert state() == [(5, "log1", 4.0)]


def test_stream_merge_moves_names_and_repeated_runs_only(spark, tmp_path, monkeypatch):
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))
    plans, sums = [], streamed.partial_sums
    monkeypatch.setattr(
        streamed, "partial_sums", lambda runs, order: plans.append(runs._jdf.queryExecution().executedPlan().toString()) or sums(runs, order)
    )
    states = []
    for rows in (
        [("log1", 1.0), ("log2", 2.0), (None, 3.0)],
        [("log2", 9.0), ("log3", 4.0), ("log3", 4.0), (None, 6.0), ("log4", 8.0), ("log4", 8.0)],
    ):
        data = [("d", "t", "A", "a", "s", name, acc) for name, acc in rows]
        spark.createDataFrame(data, RUN).coalesce(1).write.mode("append").parquet(source)
        start_merge(spark.readStream.schema(RUN).parquet(source), place, checkpoint).awaitTermination()
        states.append([(r["n_results"], r["log_name"], r["acc"]) for r in current_table(spark, place).collect()])
    assert states == [[(3, "log1", 2.0)], [(6, "log1", 4.0)]]
    assert "Exchange" not in plans[0]


def test_late_samples_are_dropped(spark, tmp_path):
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))

    def arrive(*samples):
        rows = spark.createDataFrame(samples, "run string, t string, mw double")
        rows.select("run", F.to_timestamp("t").alias("ts"), "mw").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("run string, ts timestamp, mw double").parquet(source)
        start_energy(windowed_energy(stream, "run", "ts", "mw", F.window("ts", "1 hour"), "10 minutes"), place, checkpoint).awaitTermination()

    arrive(("r", "2024-01-01 10:00:00", 3600.0), ("r", "2024-01-01 10:30:00", 3600.0), ("r", "2024-01-01 12:00:00", 1.0))
    arrive(("r", "2024-01-01 10:45:00", 99999.0), ("r", "2024-01-01 15:00:00", 1.0))
    rows = {str(r["window_start"])[11:13]: r for r in spark.read.parquet(place).withColumn("window_start", F.col("window_start").cast("string")).collect()}
    assert sorted(rows) == ["10", "12"] and rows["10"]["no_meas"] == 2
    assert rows["10"]["duration"] == 1800 and rows["10"]["energy_consumed"] == pytest.approx(3600 * 1800 / 3.6e9)
