"""Approximate nearest neighbours by an index of random-projection buckets.

Every donor is filed, once per table, under the signs of its projections on that table's directions. A query looks
into its own bucket and into those that differ in up to two of its least certain signs (smallest projections). The
donors found are compared exactly, so only neighbours can be missed, never mistaken. The index is a table (tbl, bucket,
id) that can be stored and joined again; index and query cost a join on groups of buckets, cut into chunks of bounded
size. More tables or flips find more, more signs look at fewer: see ``recall``.

Directions come from a rule (MD5), so that any engine gets the same ones. Vectors that are missing or hold a missing
number are neither filed nor looked up; equal distances are ordered by donor id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.neighbours import GROUP_ROWS, candidates
from gaugewright.operators.sums import complete, matrix
from gaugewright.session import materialize

TABLES, SIGNS, FLIPS = 8, 6, 4
GROUP_SIGNS = 6  # buckets that share their higher signs meet their queries in one group


def directions(many: int, width: int) -> np.ndarray:
    """Entry j of direction d: thousandths in [-1, 1] from the MD5 of "d-j"."""
    return np.array([
        [int(hashlib.md5(f"{d}-{j}".encode()).hexdigest()[:8], 16) % 2001 / 1000 - 1 for j in range(width)] for d in range(many)
    ])


def _filed(df: DataFrame, x: str, row_id: str, width: int, tables: int, signs: int, flips: int) -> DataFrame:
    """(id, x, cells) of each row, a cell being table * 2**signs + bucket; with flips also the buckets nearby."""
    turned = directions(tables * signs, width).T
    few = min(flips, signs)
    masks = [[b for b in range(few) if m >> b & 1] for m in range(2**few) if m.bit_count() <= 2]
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            projected = (matrix(batch.column("x")) @ turned).reshape(n, tables, signs)
            bucket = ((projected > 0) << np.arange(signs)).sum(axis=2)
            unsure = 1 << np.argsort(np.abs(projected), axis=2, kind="stable")[:, :, :few]
            probes = np.stack([bucket ^ unsure[:, :, m].sum(axis=2) for m in masks], axis=2)
            cells = (probes + (np.arange(tables) << signs)[:, None]).reshape(n, -1)
            ends = np.arange(n + 1, dtype="int32") * cells.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(cells.ravel(), pa.int64()))], ["id", "x", "cells"]
            )

    rows = df.filter(complete(F.col(x))).select(F.col(row_id).alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"id {kind}, x array<double>, cells array<long>")


def build_index(donors: DataFrame, x: str, row_id: str, width: int, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """The index of the donors: a row (tbl, bucket, id) per donor and table."""
    cells = _filed(donors, x, row_id, width, tables, signs, 0).select("id", F.explode("cells").alias("cell"))
    return cells.select(F.expr(f"CAST(cell div {1 << signs} AS INT)").alias("tbl"), F.expr(f"cell % {1 << signs}L").alias("bucket"), "id")


def hashed_neighbours(
    queries: DataFrame, donors: DataFrame, x: str, row_id: str, width: int, k: int, tables: int = TABLES, signs: int = SIGNS,
    flips: int = FLIPS, index: DataFrame | None = None,
) -> DataFrame:
    """The k nearest of the donors found for each query: (id, rank, neighbour, dist); rank counts from 1.

    Ids are distinct. No pair is written: the donors of a table's buckets, and the queries that look into them, meet in
    chunks of bounded size, where the distances are taken; a chunk reports k donors a query.
    """
    filed = index if index is not None else build_index(donors, x, row_id, width, tables, signs)
    vector = F.col(x).cast("array<double>")
    placed = filed.select("id", F.expr(f"tbl * {1 << signs}L + bucket").alias("cell")).join(
        donors.select(F.col(row_id).alias("id"), vector.alias("vec")), "id"
    )
    asked = _filed(queries, x, row_id, width, tables, signs, flips).filter("id IS NOT NULL").select(
        F.col("id").alias("qid"), F.lit(0).alias("target"), F.col("x").alias("vec"), "cells"
    )
    found = candidates(asked, placed.select("id", "vec", "cell"), width, k, 2, GROUP_ROWS, 1 << min(signs, GROUP_SIGNS))
    # a donor found in several tables counts once
    once = found.groupBy(F.col("qid").alias("id"), F.col("id").alias("neighbour")).agg(F.min("dist").alias("dist"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "neighbour")))
    return ranked.filter(F.col("rank") <= k).select("id", "rank", "neighbour", "dist")


def classify_hashed(train: DataFrame, test: DataFrame, x: str, label: str, row_id: str, width: int, k: int = 5, **how) -> DataFrame:
    """Majority label of the neighbours found, the least label of equal ones; NULL where none was found."""
    found = materialize(hashed_neighbours(test, train, x, row_id, width, k, **how))
    votes = found.join(train.select(F.col(row_id).alias("neighbour"), F.col(label).alias("_label")), "neighbour")
    counted = votes.groupBy("id", "_label").agg(F.count("*").alias("n"))
    best = counted.groupBy("id").agg(F.min_by("_label", F.struct(-F.col("n"), "_label")).alias("pred"))
    return test.select(F.col(row_id).alias("id")).join(best, "id", "left").withColumnRenamed("id", row_id)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (id, neighbour) pairs that were found."""
    hit = exact.join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hit / max(1, exact.count())
