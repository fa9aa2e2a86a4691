"""A missing key is a group like any other: no row vanishes in operators that join groups back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.meta import Property
from gaugewright.operators import clean, compare
from gaugewright.operators.folds import group_kfold
from gaugewright.operators.pca import pca_metafeatures
from gaugewright.operators.quantiles import exact_quantiles
from gaugewright.operators.ranking import ordered_rank
from gaugewright.operators.relevant import relevant_metrics
from gaugewright.plans.metalearn import add_folds
from gaugewright.plans.recommend import recalculate_values, with_truth
from gaugewright.streaming.runs import current_table, start_merge

PROPS = (
    Property("acc", "Accuracy", "ACC", "percent", "Performance", 0.5, True, True),
    Property("time", "Time", "T", "seconds", "Resources", 0.5),
)


def test_quantiles(spark):
    df = spark.createDataFrame([(k, float(i)) for k in ("a", None) for i in range(5)], "k string, v double")
    assert {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", [0.5, 1.0]).collect()} == {"a": [2.0, 4.0], None: [2.0, 4.0]}


def test_ranks(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(7)], "k string, v int")
    found = sorted((r["k"] or "", r["v"], r["rank"], r["group_size"]) for r in ordered_rank(df, ["k"], ["v"]).collect())
    assert found == [(k, i, i, 7) for k in ("", "a") for i in range(7)]


def test_folds(spark):
    df = spark.createDataFrame([(k, g) for k in ("a", None) for g in ("x", "y", "z", None) for _ in range(3)], "k string, g string")
    found = group_kfold(df, "g", 2, ["k"]).collect()
    assert len(found) == 8 and {r["k"] for r in found} == {"a", None} and {r["g"] for r in found} == {"x", "y", "z", None}


def test_components(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(a + b), float(b)) for k in ("d", None) for a, b in rng.normal(size=(20, 2))]
    found = pca_metafeatures(spark.createDataFrame(rows, "dataset string, a double, b double, y double"), ["a", "b"], "y", components=2).collect()
    assert len(found) == 2 and all(v is not None for r in found for c, v in r.asDict().items() if c != "dataset")


def test_relevant_metrics(spark):
    rows = [(d, t, 0.5, 1.0) for d in ("d", None) for t in ("train", None)]
    found = relevant_metrics(spark.createDataFrame(rows, "dataset string, task string, acc double, time double"), PROPS)
    assert {(r["dataset"], r["task"]) for r in found.collect()} == {(d, t) for d in ("d", None) for t in ("train", None)}


def test_meta_learning_folds(spark):
    rows = [(m, d, i) for m in ("A", None) for d in ("x", "y", "z", None) for i in range(4)]
    design = spark.createDataFrame(rows, "model string, dataset string, i int")
    assert add_folds(design, 2).count() == len(rows)


RATED = "configuration string, environment string, dataset string, task string, model string, acc double, time double, acc_index double, time_index double"


def rated(spark):
    from gaugewright.operators.index import idx

    rows = [("c1", None, None, "t", "A", 0.5, 2.0, 1.0, 0.5), ("c2", "e", "d", None, "B", 0.4, 1.0, 0.8, 1.0)]
    return spark.createDataFrame(rows, RATED).withColumnsRenamed({"acc_index": idx("acc"), "time_index": idx("time")})


def test_recalculated_values_and_truth(spark):
    cells = rated(spark)
    references = cells.select("dataset", "task", "environment", F.lit(0.5).alias("acc__ref"), F.lit(1.0).alias("time__ref"))
    given = cells.select("configuration", "environment", F.explode(F.array(F.lit("acc"), F.lit("time"))).alias("property"), F.lit(0.5).alias("pred"))
    assert recalculate_values(given, cells, references, PROPS).count() == 4
    assert with_truth(given, cells, PROPS).count() == 4


def test_cleaning(spark):
    df = spark.createDataFrame([("c", None, "AGL", None, 1.0), ("c", "e", "A", "d", 2.0), (None, None, "B", None, 3.0)], "configuration string, environment string, model string, dataset string, train_running_time double")
    base, rest = clean.split_models(df)
    assert base.count() == 1 and rest.count() == 2
    replaced = clean.replace_part(df, df.limit(1).withColumn("train_running_time", F.lit(9.0)))
    assert sorted(r["train_running_time"] for r in replaced.collect()) == [2.0, 3.0, 9.0]
    stats = {r["environment"]: (r["n_complete"], r["n_baselines"]) for r in clean.environment_statistics(rest, base, ["train_running_time"]).collect()}
    assert stats == {"e": (1, 0), None: (1, 1)}


def test_chains_and_costs(spark):
    df = spark.createDataFrame([(None, "e1", 1.0), (None, "e2", 2.0), ("d", "e1", 3.0)], "dataset string, environment string, v double")
    assert compare.chain(df, ["dataset"], "environment", ["v"]).count() == 1
    runs = spark.createDataFrame([(None, "d", "A", "c", 0.5, 1.0, 1.0)], "environment string, dataset string, model string, configuration string, accuracy double, train_power_draw double, power_draw double")
    costs = compare.cost_rows(runs, runs, runs.limit(0)).collect()
    assert sorted(r["source"] for r in costs) == ["EXH", "OURS"]


@pytest.mark.parametrize("again", [False, True])
def test_stream_counts_nameless_runs(spark, tmp_path, again):
    schema = "dataset string, task string, model string, architecture string, software string, log_name string, acc double"
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))
    rows = [("d", "t", "A", "a", "s", None, 1.0), ("d", "t", "A", "a", "s", None, 1.0), ("d", "t", "A", "a", "s", "one", 4.0)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    start_merge(spark.readStream.schema(schema).parquet(source), place, checkpoint).awaitTermination()
    if again:  # a named run that is delivered again counts once, a nameless one counts again
        spark.createDataFrame(rows[1:], schema).write.mode("append").parquet(source)
        start_merge(spark.readStream.schema(schema).parquet(source), place, checkpoint).awaitTermination()
    found = current_table(spark, place).collect()
    assert [(r["n_results"], r["acc"]) for r in found] == [(4, 1.75) if again else (3, 2.0)]


def test_stream_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    """The names of other buckets may even be unreadable."""
    import pathlib

    from gaugewright.streaming.runs import bucket

    schema = "dataset string, task string, model string, architecture string, software string, log_name string, acc double"
    place, checkpoint, source = (str(tmp_path / n) for n in ("table", "checkpoint", "source"))
    row = lambda name: ("d", "t", "A", "a", "s", name, 1.0)
    spark.createDataFrame([row(f"n{i}") for i in range(40)], schema).write.parquet(source)
    start_merge(spark.readStream.schema(schema).parquet(source), place, checkpoint).awaitTermination()
    own = spark.createDataFrame([("n7",)], "k string").select(bucket("k")).first()[0]
    for file in pathlib.Path(place, "names").rglob("*.parquet"):
        if f"bucket={own}" not in str(file):
            file.write_bytes(b"broken")
            crc = file.with_name(f".{file.name}.crc")
            crc.unlink(missing_ok=True)
    spark.createDataFrame([row("n7")], schema).write.mode("append").parquet(source)
    start_merge(spark.readStream.schema(schema).parquet(source), place, checkpoint).awaitTermination()
    assert current_table(spark, place).first()["n_results"] == 40
