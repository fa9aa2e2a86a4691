"""Run directories, search results, meta files, and tables on disk."""

import json

import pytest
from pyspark.sql import functions as F

from gaugewright import meta as M
from gaugewright.operators import bounds as B
from gaugewright.operators.clean import replace_part
from gaugewright.operators.merge import merge_runs
from gaugewright.sources import files, logs


def write_run(root, name, method="RF", results=True, emissions=2, processor="ARMv8 Processor rev 1 (v8l)"):
    run = root / name
    run.mkdir()
    (run / "config.json").write_text(json.dumps({"ds": "iris", "method": method, "seed": 42}, indent=4))
    content = {
        "model": {"params": 12, "fsize": 345, "hyperparam_sensitivity": 0.1},
        "metrics": {"accuracy": 0.9, "f1": 0.8, "precision": 0.7, "recall": float("nan")},
        "data": {"shape": {"train": [90, 4], "test": [30, 4]}},
    }
    (run / "results.json").write_text(json.dumps(content if results else {}))
    rows = ["timestamp,duration,energy_consumed", "t0,10.0,0.001", "t1,3.0,0.0003"]
    (run / "emissions.csv").write_text("\n".join(rows[: emissions + 1]) + "\n")
    (run / "execution_platform.json").write_text(json.dumps({"Processor": processor}))
    (run / "requirements.txt").write_text("# 3.10\nnumpy==1.0\nscikit-learn==1.4.0\n")
    (run / "model.pkl").write_bytes(b"\x00\x01")
    return run


@pytest.fixture()
def root(tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    write_run(folder, "train_2024_01")
    write_run(folder, "train_2024_02", results=False)
    write_run(folder, "train_2024_03", emissions=1)
    (write_run(folder, "train_2024_04") / "results.json").write_text("{broken")
    (write_run(folder, "infer_2024_05") / "requirements.txt").unlink()
    return folder


def test_run_directories_to_properties(spark, root):
    found = {r["log_name"]: r for r in logs.extract_properties(logs.read_run_directories(spark, str(root))).collect()}
    assert len(found) == 5
    good = found["train_2024_01"]
    assert (good["task"], good["dataset"], good["model"]) == ("train", "iris", "RF")
    assert (good["architecture"], good["software"]) == ("ARMv8 rev 1 (v8l)", "Scikit-learn 1.4.0")
    assert good["train_running_time"] == 10.0 and good["train_power_draw"] == pytest.approx(3600.0)
    assert good["running_time"] == pytest.approx(0.1) and good["power_draw"] == pytest.approx(36.0)
    assert good["parameters"] == 12 and good["accuracy"] == 0.9 and good["recall"] is None
    assert found["train_2024_02"]["accuracy"] is None and found["train_2024_02"]["train_running_time"] == 10.0
    assert found["train_2024_03"]["running_time"] is None and found["train_2024_03"]["train_running_time"] == 10.0
    assert found["train_2024_04"]["accuracy"] is None and found["train_2024_04"]["dataset"] == "iris"
    assert found["infer_2024_05"]["accuracy"] is None and found["infer_2024_05"]["task"] == "infer"


def test_incremental_ingestion(spark, root, tmp_path):
    bronze = str(tmp_path / "bronze")
    assert logs.ingest_directories(spark, str(root), bronze).count() == 5
    write_run(root, "train_2024_06")
    assert logs.ingest_directories(spark, str(root), bronze).count() == 6
    (root / "train_2024_01" / "config.json").write_text('{"ds": "changed"}')  # known directories are not opened again
    again = logs.ingest_directories(spark, str(root), bronze)
    assert again.count() == 6 and again.filter("config.ds = 'changed'").isEmpty()


def test_odd_directory_names(spark, tmp_path):
    root, bronze = tmp_path / "odd", str(tmp_path / "bronze")
    names = ["train_a", "train_b[1]", "train c{2}", "train_d+e", "train_f%41", "train_g*", "train_h?", "train_i,j", "train_k^", "train_\u00e9"]
    root.mkdir()
    for name in names:
        write_run(root, name)
    found = logs.ingest_directories(spark, str(root), bronze)
    assert sorted(r[0] for r in found.select("directory_name").collect()) == sorted(names)
    assert logs.ingest_directories(spark, str(root), bronze).count() == len(names)


def test_many_directories_in_parts(spark, tmp_path, monkeypatch):
    """Only new directories are opened, a few hundred with each scan."""
    root, bronze = tmp_path / "many", str(tmp_path / "bronze")
    root.mkdir()
    for i in range(450):
        write_run(root, f"run_{i}")
    monkeypatch.setattr(logs, "AT_ONCE", 200)
    opened = []
    read = logs.read_run_directories
    monkeypatch.setattr(logs, "read_run_directories", lambda spark, root, some: opened.append(len(some)) or read(spark, root, some))
    assert logs.ingest_directories(spark, str(root), bronze).count() == 450 and opened == [200, 200, 50]
    write_run(root, "run_new")
    assert logs.ingest_directories(spark, str(root), bronze).count() == 451 and opened[3:] == [1]


def test_quoted_emissions(spark):
    text = 'cpu,duration,gpu,energy_consumed\r\n"Intel, ""i7""",10.0,x,0.5\r\n,3.5,"a,b",\r\n\r\n'
    df = spark.createDataFrame([(text,), ("duration\n1",), ("",), (None,)], "t string").select(logs.parse_emissions(F.col("t")).alias("e"))
    assert [r["e"] and [tuple(x) for x in r["e"]] for r in df.collect()] == [[(10.0, 0.5), (3.5, None)], [(1.0, None)], [], None]


def test_merge_keeps_small_numbers_and_null_keys(spark):
    from gaugewright.meta import Property
    from gaugewright.operators.index import idx, index_best
    from gaugewright.operators.share import share_independent

    rows = [(None, "t", "m", "a", "s", "l1", 1e-10), ("d", None, "m", "a", "s", "l2", 3e-10), ("d", "t", "m", None, "s", "l3", 1.0)]
    schema = "dataset string, task string, model string, architecture string, software string, log_name string, v double"
    merged = merge_runs(spark.createDataFrame(rows, schema))
    assert sorted(r["v"] for r in merged.collect()) == [1e-10, 3e-10, 1.0]
    props = [Property("v", "v", "v", "s", "Resources", 1.0, False, True)]
    indexed = index_best(merged, props)
    assert indexed.count() == 3 and indexed.filter(f"{idx('v')} = 1").count() == 3
    assert share_independent(indexed.withColumn("v__rating", F.lit(0)), props).count() == 3


def test_merged_logs_reject_broken_files(spark, tmp_path):
    folder = tmp_path / "merged"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"directory_name": "train_1", "config": {"ds": "d", "method": "m"}}))
    (folder / "b.json").write_text("{nonsense")
    both = {"duration": {"0": 10.0, "1": 3.0}, "energy_consumed": {"1": 0.5, "0": 0.25}}
    (folder / "c.json").write_text(json.dumps({"directory_name": "train_2", "emissions": both}, indent=4))
    (folder / "d.json").write_text(json.dumps({"directory_name": None, "emissions": [{"duration": 1.0}]}, indent=4))
    good, bad = logs.read_merged_logs(spark, str(folder))
    rows = {r["directory_name"]: r["emissions"] and [tuple(e) for e in r["emissions"]] for r in good.collect()}
    assert rows == {"train_1": None, "train_2": [(10.0, 0.25), (3.0, 0.5)], None: [(1.0, None)]}
    assert [r["_corrupt"] for r in bad.collect()] == ["{nonsense"]


def test_search_results(spark, tmp_path):
    content = {"params": [{"C": 1.0}, {"C": 2.0}, {"C": 3.0}], "mean_test_score": [0.5, float("nan")],
               "std_test_score": [0.1, float("nan")], "rank_test_score": [1, 2]}
    (tmp_path / "hyperparameters__v0_2___lung_cancer__LR.json").write_text(json.dumps(content, indent=4))
    rows = files.read_search_results(spark, str(tmp_path)).orderBy("pos").collect()
    assert {(r["dataset"], r["method"]) for r in rows} == {("v0_2___lung_cancer", "LR")}
    assert [r["params"]["C"] for r in rows] == ["1.0", "2.0", "3.0"]
    assert rows[0]["mean_test_score"] == 0.5 and rows[1]["mean_test_score"] != rows[1]["mean_test_score"]
    assert rows[2]["mean_test_score"] is None and rows[2]["rank_test_score"] is None


def test_metafeature_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",x,y\nd1,1.5,\nd2,2,3\n")
    (tmp_path / "b.csv").write_text(",z\nd2,7\nd3,8\n")
    left, right = (files.read_metafeatures(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv"))
    rows = {r["dataset"]: (r["x"], r["y"], r["z"]) for r in files.combine_metafeatures(left, right).collect()}
    assert rows == {"d1": (1.5, 0.0, None), "d2": (2.0, 3.0, 7.0), "d3": (None, None, 8.0)}


def test_meta_files(spark, tmp_path):
    described = {"accuracy": {"name": "Accuracy", "shortname": "ACC", "unit": "percent", "group": "Performance", "weight": 0.5, "maximize": True},
                 "time": {"name": "Time", "unit": "seconds", "group": "Resources", "weight": 0.5}}
    (tmp_path / "meta_properties.json").write_text(json.dumps(described))
    (tmp_path / "other.json").write_text("{}")
    config = M.load_meta(spark, str(tmp_path))
    assert list(config) == ["properties"]
    accuracy, time = M.properties_from_meta(config)
    assert accuracy.maximize and not accuracy.independent and time.shortname == "time"


def test_rateable_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], "model string, accuracy double, other int")
    assert [p.key for p in M.rateable(df, M.DEFAULT_PROPERTIES)] == ["accuracy"]
    unknown = M.rateable(df)[1]
    assert (unknown.key, unknown.shortname, unknown.group, unknown.weight) == ("other", "othe", "Performance", 1.0)
    with pytest.raises(ValueError):
        M.rateable(df.select("model"))


def test_weights(spark):
    same, changed = M.with_weights(M.DEFAULT_PROPERTIES, {"accuracy": 0.125})
    assert not changed and same == M.DEFAULT_PROPERTIES
    assert M.with_weights(M.DEFAULT_PROPERTIES, {"accuracy": 1})[1]
    assert json.loads(M.weights_json(M.DEFAULT_PROPERTIES))["f1"] == 0.125


def test_database_round_trip_and_partial_replacement(spark, tmp_path):
    df = spark.createDataFrame([("c1", "e", "d1", 1.0), ("c2", "e", "d2", 2.0)], "configuration string, environment string, dataset string, v double")
    path = str(tmp_path / "db")
    files.save_database(df, path)
    files.save_database(df.filter("dataset = 'd1'").withColumn("v", F.lit(5.0)), path)
    assert {(r["configuration"], r["v"]) for r in files.load_database(spark, path).collect()} == {("c1", 5.0), ("c2", 2.0)}
    part = df.filter("dataset = 'd2'").withColumn("v", F.lit(9.0))
    assert {(r["configuration"], r["v"]) for r in replace_part(df, part).collect()} == {("c1", 1.0), ("c2", 9.0)}


def test_json_sink_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, v double")
    files.write_json(df, str(tmp_path / "j"))
    back = spark.read.schema("i int, v double").json(str(tmp_path / "j"))
    assert {(r["i"], r["v"]) for r in back.collect()} == {(1, None), (2, 0.5)}


def test_sparse_entries(spark):
    sparse = spark.createDataFrame([("a", "x", "1.5"), ("b", "y", "text"), ("b", "x", "2")], "row string, property string, value string")
    rows = {r["row"]: (r["x"], r["y"], r["environment"]) for r in files.densify(sparse, ["row"], ["x", "y"]).collect()}
    assert rows == {"a": (1.5, None, "unknown"), "b": (2.0, None, "unknown")}


def test_boundaries_survive_editing(spark):
    table = B.fixed_boundaries(spark, {"p": [0.9, 0.8, 0.7, 0.6], "default": [0.5, 0.4, 0.3, 0.2]})
    again = {r["property"]: r["bounds"] for r in B.intervals_to_bounds(B.intervals(table)).collect()}
    assert again["p"] == [0.9, 0.8, 0.7, 0.6]
    filled = B.complete_boundaries(B.collect_boundaries(table), M.DEFAULT_PROPERTIES[:1])
    assert filled == {"accuracy": [0.5, 0.4, 0.3, 0.2]}


def test_merge_takes_first_text_and_mean(spark):
    rows = [("d", "t", "m", "a", "s", "log2", "x", 1.0, None), ("d", "t", "m", "a", "s", "log1", None, 2.0, None)]
    schema = "dataset string, task string, model string, architecture string, software string, log_name string, note string, v double, w double"
    got = merge_runs(spark.createDataFrame(rows, schema)).first()
    assert (got["n_results"], got["log_name"], got["note"], got["v"], got["w"]) == (2, "log1", "x", 1.5, None)
    assert (got["configuration"], got["environment"]) == ("t - d - m", "a - s")
