"""One pass over rows that ends in a single vector of sums: the step of every iterative fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vector_sum(df: DataFrame, size: int, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``partial(batch)`` over all rows; a partition sends one vector, whatever its rows.

    ``size`` is fixed by the model, not by the data, and so is what reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "s"])

    found = df.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[found["i"].to_numpy()] = found["s"].to_numpy()
    return out


def complete(x: Column) -> Column:
    """Whether an array has no missing number."""
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def coded(df: DataFrame, x: str, label: str, classes: list | None = None, keep=()) -> tuple[DataFrame, list]:
    """Rows (keep, x, y) with the label's place among the sorted classes; rows with gaps are left out.

    The classes are part of the model: one entry each on the driver.
    """
    whole = df.filter(F.col(label).isNotNull() & complete(F.col(x)))
    if classes is None:
        classes = [r[0] for r in whole.select(label).distinct().orderBy(label).collect()]
    kind = dict(df.dtypes)[label]
    place = F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col(label)) - 1 if classes else F.lit(-1)
    return whole.select(*keep, F.col(x).cast("array<double>").alias("x"), place.cast("int").alias("y")).filter("y >= 0"), classes


def classified(df: DataFrame, x: str, classes: list, scores: Callable[[np.ndarray], np.ndarray], label_type: str, out: str = "pred") -> DataFrame:
    """Adds the class with the highest score, the first of equal ones; rows with gaps get NULL."""
    kind = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[label_type]
    names = pa.array(classes, kind)
    kept = [f for f in df.schema.fields if f.name != out]
    given = df.select(*[f.name for f in kept], F.when(complete(F.col(x)), F.col(x).cast("array<double>")).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("_x")
                known = column.is_valid().to_numpy(zero_copy_only=False)
                best = np.full(batch.num_rows, -1)
                if known.any():
                    best[known] = scores(matrix(column.drop_null())).argmax(axis=1)
                found = names.take(pa.array(best, mask=~known))
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [found], [f.name for f in kept] + [out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` {label_type}"])
    return given.mapInArrow(run, schema)
