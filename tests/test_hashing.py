"""Bucketed neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators.hashing import build_index, classify_hashed, hashed_neighbours, recall

SCHEMA = "vec_id long, z array<double>, label int, id string, rank string, dist string, bucket string"


def vectors(n, seed, start=0, width=16):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(0).normal(size=(6, width)) * 2
    label = rng.integers(0, 6, n)
    return [(start + i, (centers[c] + rng.normal(size=width)).tolist(), int(c), "a", "b", "c", "d") for i, c in enumerate(label)]


def exact(queries, donors, k):
    out = []
    for q in queries:
        far = sorted((round(float(np.linalg.norm(np.subtract(q[1], d[1]))), 9), d[0]) for d in donors)
        out += [(q[0], d, r) for r, (_, d) in enumerate(far[:k], 1)]
    return out


def test_recall_and_exact_distances(spark):
    donors, queries = vectors(900, 1), vectors(60, 2, 5000)
    gaps = [(9000, None, 1, "", "", "", ""), (9001, [1.0] * 15 + [None], 1, "", "", "", "")]
    d, q = spark.createDataFrame(donors + gaps, SCHEMA).repartition(3), spark.createDataFrame(queries + gaps, SCHEMA)
    found = hashed_neighbours(q, d, "z", "vec_id", 16, 5, tables=12, signs=9).cache()
    want = spark.createDataFrame([r[:2] for r in exact(queries, donors, 5)], "id long, neighbour long")
    assert recall(found, want) >= 0.9
    by_id = {x[0]: x[1] for x in donors + queries}
    rows = found.collect()
    assert all(abs(np.linalg.norm(np.subtract(by_id[r["id"]], by_id[r["neighbour"]])) - r["dist"]) < 1e-8 for r in rows)
    assert {r["id"] for r in rows} == {x[0] for x in queries} and max(r["rank"] for r in rows) == 5
    looked = hashed_neighbours(q, d, "z", "vec_id", 16, 10_000, tables=12, signs=9).count()
    assert looked < 0.5 * len(donors) * len(queries)  # most pairs are not compared


def test_all_buckets_are_exact(spark):
    """One sign and one flip reach every bucket."""
    donors, queries = vectors(80, 3), vectors(9, 4, 500)
    donors += [(700 + i, donors[0][1], 0, "", "", "", "") for i in range(6)]  # copies: ties by id
    found = hashed_neighbours(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(donors, SCHEMA), "z", "vec_id", 16, 7, tables=1, signs=1, flips=1)
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in found.collect()) == sorted(exact(queries, donors, 7))


def test_no_row_per_pair(spark):
    """Vectors that share all buckets: k rows a table and chunk leave the comparison, not every pair."""
    donors, queries = vectors(400, 8), vectors(50, 9, 5000)
    donors = [(d[0], donors[0][1], *d[2:]) for d in donors]
    queries = [(q[0], donors[0][1], *q[2:]) for q in queries]
    d, q = spark.createDataFrame(donors, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    found = hashed_neighbours(q, d, "z", "vec_id", 16, 3, tables=2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") and "chunk" in plan  # the pairs are made and measured inside the chunks
    assert sorted((r["id"], r["rank"], r["neighbour"], r["dist"]) for r in found.collect()) == [(5000 + i, n + 1, n, 0.0) for i in range(50) for n in range(3)]


def test_stored_index_and_classes(spark, tmp_path):
    donors, queries = vectors(300, 5), vectors(40, 6, 900)
    d, q = spark.createDataFrame(donors, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    build_index(d, "z", "vec_id", 16).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 300 * 8
    a = hashed_neighbours(q, d, "z", "vec_id", 16, 3, index=index).collect()
    assert sorted(a) == sorted(hashed_neighbours(q, d, "z", "vec_id", 16, 3).collect())
    pred = {r["vec_id"]: r["pred"] for r in classify_hashed(d, q, "z", "label", "vec_id", 16).collect()}
    assert np.mean([pred[x[0]] == x[2] for x in queries]) > 0.9


@pytest.mark.parametrize("empty", ["queries", "donors"])
def test_empty_tables(spark, empty):
    rows = spark.createDataFrame(vectors(5, 7), SCHEMA)
    none = rows.filter(F.lit(False))
    q, d = (none, rows) if empty == "queries" else (rows, none)
    assert hashed_neighbours(q, d, "z", "vec_id", 16, 3).count() == 0
