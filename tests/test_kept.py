"""Kept boundaries against boundaries of all rows."""

import random

import pytest
from pyspark.sql import DataFrameWriter

from gaugewright.meta import Property
from gaugewright.operators import kept
from gaugewright.operators.bounds import optimal_boundaries
from gaugewright.operators.index import index_best

SCHEMA = "dataset string, task string, environment string, up double, down double, extra string"


@pytest.fixture(scope="module")
def properties():
    return (Property("up", "Up", "U", "", "Performance", 0.5, True), Property("down", "Down", "D", "", "Resources", 0.5))


def batch(seed, n=60, groups=4):
    r = random.Random(seed)
    value = [None, 0.0, -1.5, *[round(r.uniform(0.1, 9), 3) for _ in range(9)]]
    return [
        (r.choice([None, "", *map(str, range(groups))]), r.choice(["t", None]), "e", r.choice(value), r.choice(value), "x") for _ in range(n)
    ]


def bounds(frame):
    return {r["property"]: list(r["bounds"]) for r in frame.collect()}


def full(spark, rows, properties):
    return bounds(optimal_boundaries(index_best(spark.createDataFrame(rows, SCHEMA), properties), properties))


def test_equals_all_rows_after_every_batch(spark, tmp_path, properties):
    seen = []
    for number in range(4):
        rows = batch(number) if number != 2 else []  # an empty batch between
        kept.add_batch(spark.createDataFrame(rows, SCHEMA), str(tmp_path), number, properties)
        seen += rows
        assert bounds(kept.kept_boundaries(spark, str(tmp_path))) == full(spark, seen, properties)
    kept.add_batch(spark.createDataFrame(batch(3), SCHEMA), str(tmp_path), 3, properties)  # repeated: replaces itself
    assert bounds(kept.kept_boundaries(spark, str(tmp_path))) == full(spark, seen, properties)


def test_first_batch_empty_and_nothing_kept(spark, tmp_path, properties):
    assert bounds(kept.kept_boundaries(spark, str(tmp_path / "none"))) == {}
    kept.add_batch(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"), 0, properties)
    assert bounds(kept.kept_boundaries(spark, str(tmp_path / "a"))) == {}
    kept.add_batch(spark.createDataFrame(batch(9), SCHEMA), str(tmp_path / "a"), 1, properties)
    assert bounds(kept.kept_boundaries(spark, str(tmp_path / "a"))) == full(spark, batch(9), properties)


def test_broken_off_batch_does_not_count(spark, tmp_path, properties, monkeypatch):
    kept.add_batch(spark.createDataFrame(batch(1), SCHEMA), str(tmp_path), 0, properties)
    write = DataFrameWriter.parquet

    def breaking(self, path, *rest, **options):
        if path.endswith("references/batch=1"):
            raise RuntimeError("lost")
        return write(self, path, *rest, **options)

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(DataFrameWriter, "parquet", breaking)
        kept.add_batch(spark.createDataFrame(batch(2), SCHEMA), str(tmp_path), 1, properties)
    assert bounds(kept.kept_boundaries(spark, str(tmp_path))) == full(spark, batch(1), properties)
    kept.add_batch(spark.createDataFrame(batch(2), SCHEMA), str(tmp_path), 1, properties)
    assert bounds(kept.kept_boundaries(spark, str(tmp_path))) == full(spark, batch(1) + batch(2), properties)


def test_reads_only_changed_groups(spark, tmp_path, properties, monkeypatch):
    first = [(str(i), "t", "e", 5.0 + j, 5.0 + j, "x") for i in range(40) for j in range(3)]
    kept.add_batch(spark.createDataFrame(first, SCHEMA), str(tmp_path), 0, properties)
    later = [(str(i), "t", "e", 5.5, 5.5, "x") for i in range(40)] + [("7", "t", "e", 99.0, 6.0, "x")]  # only 7 gets a better value
    looked = []
    real = kept.older_rows

    def spy(rows, number, changed, keys):
        old = real(rows, number, changed, keys)
        looked.append((sorted(r["dataset"] for r in changed.collect()), old.inputFiles(), old.count()))
        plan = old._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0]
        return old

    monkeypatch.setattr(kept, "older_rows", spy)
    kept.add_batch(spark.createDataFrame(later, SCHEMA), str(tmp_path), 1, properties)
    assert looked[0][0] == ["7"] and looked[0][2] == 3
    assert bounds(kept.kept_boundaries(spark, str(tmp_path))) == full(spark, first + later, properties)
