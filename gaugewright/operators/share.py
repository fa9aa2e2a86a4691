"""Making task-independent cells available in all tasks of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import quoted
from gaugewright.operators.index import idx, rat
from gaugewright.operators.joins import join_groups


def share_independent(df: DataFrame, properties) -> DataFrame:
    """If any row of a (dataset, model, environment) group lacks a task-independent value, every row of the
    group takes the first available cell, ordered by configuration.
    """
    shared = [p for p in properties if p.independent]
    if not shared:
        return df
    keys = ["dataset", "model", "environment"]
    first_cells = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[a for p in shared for a in _first_cell(p.key)])
    joined = join_groups(df, first_cells, keys)
    replaced = {}
    for p in shared:
        use = f"{quoted(p.key + '__n')} > 0 AND {quoted(p.key + '__n')} < _rows"
        for c in (p.key, idx(p.key), rat(p.key)):
            replaced[c] = F.expr(f"if({use}, {quoted(p.key + '__first')}.{quoted(c)}, {quoted(c)})")
    return joined.withColumns(replaced).select(*df.columns)


def _first_cell(key: str):
    cell = ", ".join(quoted(c) for c in (key, idx(key), rat(key)))
    first = f"CASE WHEN {quoted(key)} IS NOT NULL THEN struct(configuration, environment) END"
    return (
        F.expr(f"count({quoted(key)}) AS {quoted(key + '__n')}"),
        F.expr(f"min_by(struct({cell}), {first}) AS {quoted(key + '__first')}"),
    )
