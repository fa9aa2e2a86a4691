"""Costly parts of expressions and plans stand once, whatever uses their result."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewright.functions import units as U
from gaugewright.operators import pca as pca_module
from gaugewright.operators import perceptron as perceptron_module
from gaugewright.operators import quantiles as quantiles_module
from gaugewright.operators.gram import parted
from gaugewright.operators.quantiles import exact_quantiles, stored_quantiles
from gaugewright.sources import logs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_a_line_are_cut_once(spark):
    text = 'cpu,"odd, name",duration,energy_consumed\r\n"a ""b""","x,y",1.5,2\n\n,," 3 ",\n'
    df = spark.createDataFrame([(text,)], "t string").repartition(1).select(logs.parse_emissions(F.col("t")).alias("e"))
    assert [tuple(r) for r in df.first()["e"]] == [(1.5, 2.0), (3.0, None)]
    assert plan(df).count("regexp_extract_all") == 2  # header, other lines


def test_a_long_quoted_field(spark):
    text = "duration,name,energy_consumed\n1,\"" + "x, " * 20000 + '",2\n'
    df = spark.createDataFrame([(text,)], "t string").select(logs.parse_emissions(F.col("t")).alias("e"))
    assert [tuple(r) for r in df.first()["e"]] == [(1.0, 2.0)]


def test_files_of_a_run_are_sorted_by_a_number_first(spark):
    files = spark.createDataFrame([("a", "config.json", '{"ds": "x"}'), (None, "requirements.txt", "p==1")], "directory_name string, file string, value string")
    df = logs.assemble_runs(files)
    assert sorted((r["directory_name"] or "", r["config"] and r["config"]["ds"], r["requirements"]) for r in df.collect()) == [("", None, ["p==1"]), ("a", "x", None)]
    assert "xxhash64(directory_name" in plan(df)


def test_merged_log_is_parsed_once(spark):
    texts = spark.createDataFrame([('{"directory_name": "a", "emissions": {"duration": {"1": 2, "0": 1}}}',), ('{"directory_name": "b", "emissions": [{"duration": 3}]}',), ('{"dir',), (None,)], "value string")
    good, bad = logs.parse_merged_logs(texts.repartition(1))
    assert sorted((r["directory_name"], [e["duration"] for e in r["emissions"]]) for r in good.collect()) == [("a", [1.0, 2.0]), ("b", [3.0])]
    assert sorted(r[0] or "" for r in bad.collect()) == ["", '{"dir']
    assert plan(good).count("from_json") == 3  # the log, emissions as rows, as columns


@pytest.mark.parametrize("x, want", [(9995.0, "1.00e+4"), (-0.00009996, "-1.00e-4"), (12450.0, "1.24e+4"), (12350.0, "1.24e+4"), (1e-12, "1.00e-12"), (-999600.0, "-1.00e+6"), (0.0, "0.00e+0")])
def test_scientific(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double").repartition(1).select(U.scientific(F.col("x")).alias("text"))
    assert df.first()[0] == want
    assert plan(df).count("POWER(") == 1


def test_equal_rows_of_a_perceptron_are_read_as_one(spark, monkeypatch):
    seen = []
    real = perceptron_module.vector_sum
    monkeypatch.setattr(perceptron_module, "vector_sum", lambda df, *rest: seen.append(df.count()) or real(df, *rest))
    plain = [([float(i % 3), float(i % 2)], i % 2) for i in range(60)]
    df = spark.createDataFrame(plain + [(None, 1), ([1.0, float("nan")], 0)], "x array<double>, y int").repartition(3)
    model = perceptron_module.perceptron(df, "x", "y", hidden=(2,), alpha=0.1, activation="tanh", solver="gd", rounds=4, tolerance=0.0)
    assert set(seen) == {6}
    x, y = np.array([r[0] for r in plain]), np.array([r[1] for r in plain])
    free = np.concatenate([np.vstack([np.zeros((1, b)), np.ones((a, b))]).ravel() for a, b in zip(model.sizes, model.sizes[1:])])
    w = perceptron_module.first_weights(model.sizes)
    for _ in range(3):
        w = w - 0.1 * (perceptron_module.loss_and_gradient(w, model.sizes, x, y, "tanh")[1:] + 0.1 * free * w) / len(y)
    assert np.allclose(model.weights, w, rtol=0, atol=1e-12)


def test_quantiles_of_stored_rows(spark):
    values = [(k, v) for k, f in (("a", lambda i: i * 0.37 - 20), ("b", lambda i: 5.0), (None, lambda i: -1.5 ** (i % 40)), ("c", lambda i: 1 + i * 1e-9)) for i in range(501) for v in [f(i)]]
    df = spark.createDataFrame(values + [("a", None), ("d", None), ("e", 1.0), ("e", 2.0)], "k string, v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got, want = ({r["k"]: r["q"] for r in f(df, ["k"], "v", probs).collect()} for f in (stored_quantiles, exact_quantiles))
    assert got == want and set(got) == {"a", "b", "c", "e", None}


def test_only_values_near_the_wanted_rank_are_counted(spark, monkeypatch):
    stored = []
    real = quantiles_module.materialize
    monkeypatch.setattr(quantiles_module, "materialize", lambda df: stored.append(real(df)) or stored[-1])
    df = spark.range(20000).selectExpr("'a' AS k", "1 + id / 1000D AS v")
    assert stored_quantiles(df, ["k"], "v", [0.5]).first()["q"] == pytest.approx([10.9995])
    assert stored[-1].count() < 1000


@pytest.mark.parametrize("keys", [["a", "b"], ["a"], []])
def test_rows_of_a_batch_by_key(keys):
    batch = pa.RecordBatch.from_pydict({"a": ["x", None, "y", "x", None, "x"], "b": [1, 2, None, 2, 2, 1]})
    matrix = np.arange(12.0).reshape(6, 2)
    want = {}
    for i, r in enumerate(batch.to_pylist()):
        want.setdefault(tuple(r[k] for k in keys), []).append(matrix[i].tolist())
    assert {k: rows.tolist() for k, rows in parted(batch, matrix, keys)} == want


def test_component_scores_lie_side_by_side(spark, monkeypatch):
    stored = []
    real = pca_module.materialize
    monkeypatch.setattr(pca_module, "materialize", lambda df: stored.append(real(df)) or stored[-1])
    rows = [(k, float(i), float(i * i % 7), i % 3) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "dataset string, x double, y double, code int")
    found = pca_module.pca_metafeatures(df, ["x", "y"], "code")
    assert stored[0].count() == len(rows)
    assert {r["dataset"] for r in found.collect()} == {"a", None}
    scores = pca_module.project(df, ["dataset"], ["x", "y", "code"], 3).filter("dataset = 'a' AND component = 1").toPandas()["score"]
    one = found.filter("dataset = 'a'").first()
    assert [one[f"1_{n}"] for n in ("min", "max", "mean", "std", "median")] == pytest.approx([scores.min(), scores.max(), scores.mean(), scores.std(ddof=0), scores.median()], abs=1e-9)
