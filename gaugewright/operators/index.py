"""Relative indices inside a (dataset, task, environment) group, and back to values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import double, index_to_value, quoted, scaled_index
from gaugewright.meta import BOTTOM, GROUP_KEYS, TOP
from gaugewright.operators.joins import join_groups


def idx(key: str) -> str:
    return f"{key}__index"


def rat(key: str) -> str:
    return f"{key}__rating"


def best_references(df: DataFrame, properties, keys=GROUP_KEYS) -> DataFrame:
    """Best value of every property per group: one partial aggregation, whatever the group sizes."""
    return df.groupBy(*keys).agg(*[
        F.expr(f"CAST({'max' if p.maximize else 'min'}({quoted(p.key)}) AS DOUBLE) AS {quoted(p.key + '__ref')}")
        for p in properties
    ])


def add_indices(df: DataFrame, references: DataFrame, properties, keys=GROUP_KEYS) -> DataFrame:
    """Add one index column per property.

    The reference table has one row per group and joins back to the rows; the join is left to adaptive
    execution, which broadcasts it by its measured size or splits a hot group.
    An index is NULL only if the whole group lacks the property.  Rows with a NULL key form groups too.
    """
    columns = []
    for p in properties:
        index = scaled_index(quoted(p.key), quoted(f"{p.key}__ref"), p.maximize)
        if f"{p.key}__present" in references.columns:
            index = f"CASE WHEN {quoted(p.key + '__present')} THEN {index} END"
        columns.append(f"{index} AS {quoted(idx(p.key))}")
    return join_groups(df, references, keys).selectExpr(*[quoted(c) for c in df.columns], *columns)


def index_best(df: DataFrame, properties) -> DataFrame:
    return add_indices(df, best_references(df, properties), properties)


def long_cells(df: DataFrame, properties, keep, parts=("value", "index")) -> DataFrame:
    """One row per row and property with the chosen parts (value, index, rating) as columns."""
    source = {"value": lambda k: k, "index": idx, "rating": rat}
    types = {"rating": "INT"}
    cells = ", ".join(
        f"named_struct('property', '{p.key}', "
        + ", ".join(f"'{part}', CAST({quoted(source[part](p.key))} AS {types.get(part, 'DOUBLE')})" for part in parts) + ")"
        for p in properties
    )
    return df.selectExpr(*[quoted(k) for k in keep], f"inline(array({cells}))")


def real_boundaries(df: DataFrame, bounds: dict, properties, keys=GROUP_KEYS) -> DataFrame:
    """Boundaries of every band as property values per group, for boundaries as a dict."""
    def aggregates(p):
        value, index = quoted(p.key), quoted(idx(p.key))
        return (
            F.expr(f"CAST(max_by({value}, struct({index}, {value})) AS DOUBLE) AS {quoted(p.key + '__top')}"),
            F.expr(f"count({index}) AS {quoted(p.key + '__n')}"),
        )

    def bands(p):
        edges = [double(TOP), *[double(b) for b in bounds[p.key]], double(BOTTOM)]
        top, n = quoted(f"{p.key}__top"), quoted(f"{p.key}__n")
        return ", ".join(
            f"named_struct('property', '{p.key}', 'n', {n}, 'band', {i}, "
            f"'start', {index_to_value(edges[i], top, p.maximize)}, 'stop', {index_to_value(edges[i + 1], top, p.maximize)})"
            for i in range(len(edges) - 1)
        )

    tops = df.groupBy(*keys).agg(*[a for p in properties for a in aggregates(p)])
    found = tops.selectExpr(*keys, f"inline(array({', '.join(bands(p) for p in properties)}))")
    return found.filter("n > 0").drop("n")
