"""Pearson correlations between properties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import quoted
from gaugewright.operators.gram import HELD
from gaugewright.operators.index import idx


def pair_correlations(df: DataFrame, properties, keys=("dataset", "task"), least: int = 3) -> DataFrame:
    """Correlation of every two indices per key.

    An index of 0 stands for a missing value and does not count; fewer than ``least`` complete rows give
    NULL.  Every partition is reduced to sums per key before anything is shuffled: rows are neither copied nor moved.
    """
    names = [p.key for p in properties]
    vector = F.array(*[F.expr(f"nullif({quoted(idx(p.key))}, 0)").cast("double") for p in properties])
    sums = pair_sums(df.select(*keys, vector.alias("v")), list(keys), "v")
    label = F.array(*[F.lit(n) for n in names])
    corr = F.when(F.col("n") >= least, correlation())
    return sums.filter("i < j").select(*keys, F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), "n", corr.alias("corr"))


def correlation():
    """Pearson correlation from the sums of a pair, NULL if one side is constant."""
    def part(c: str):
        return F.try_divide(F.col(c), F.col("n"))

    var_x, var_y = (part(f"{s}{s}") - part(s) * part(s) for s in "xy")
    # sums of squares of equal numbers differ in the last digits only
    moving = (var_x > 1e-13 * part("xx")) & (var_y > 1e-13 * part("yy"))
    return F.when(moving, (part("xy") - part("x") * part("y")) / F.sqrt(var_x) / F.sqrt(var_y))


def pair_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per key and two places i <= j of a vector, over the rows that have both: n, sums x, y, xx, yy, xy."""
    types = dict(df.dtypes)
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                i, j = np.triu_indices(total.shape[1])
                columns = [pa.array([value] * len(i), t) for value, t in zip(key, kinds, strict=True)]
                columns += [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[0][i, j].astype(np.int64))]
                columns += [pa.array(t[i, j]) for t in total[1:]]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "i", "j", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            matrix = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            labels: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True) if keys else ()):
                labels.setdefault(key, []).append(at)
            for key, at in labels.items() if keys else [((), slice(None))]:
                there = ~np.isnan(matrix[at])
                m, v = there.astype(float), np.where(there, matrix[at], 0.0)
                sums = np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
                held[key] = held.get(key, 0.0) + sums
            if len(held) * matrix.shape[1] ** 2 * len(names) > HELD:
                yield from flush()
                held.clear()
        yield from flush()

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["i int, j int, n long"] + [f"{c} double" for c in names[1:]])
    return df.select(*keys, vector).mapInArrow(partial, schema).groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Correlation of every two columns over all complete rows; the diagonal is 0.  One pass of sums."""
    columns = list(columns)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    sums = pair_sums(df.dropna("any", subset=columns).select(vector.alias("v")), [], "v")
    names = F.array(*[F.lit(c) for c in columns])
    found = sums.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", correlation().alias("corr"))
    same = found.filter("i = j").select("a", "b", F.lit(0.0).alias("corr"))
    pairs = found.filter("i < j")
    return same.union(pairs.select("a", "b", "corr")).union(pairs.select("b", "a", "corr"))
