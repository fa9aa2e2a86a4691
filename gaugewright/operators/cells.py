"""Struct cells: the outward form of a rated table, and projections of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.units import format_measure
from gaugewright.operators.index import idx, rat


def as_cells(df: DataFrame, properties) -> DataFrame:
    """Every property column becomes a struct of meta, value, text, index and rating; NULL where the whole
    group lacks the property."""
    cells = {}
    for p in properties:
        fmt_val, fmt_unit = format_measure(F.col(p.key), p.unit)
        cell = F.struct(
            F.lit(p.title).alias("name"), F.lit(p.shortname).alias("shortname"), F.lit(p.unit).alias("unit"),
            F.lit(p.group).alias("group"), F.lit(p.weight).alias("weight"), F.lit(p.maximize).alias("maximize"),
            F.lit(p.independent).alias("independent_of_task"), F.col(p.key).alias("value"),
            fmt_val.alias("fmt_val"), fmt_unit.alias("fmt_unit"),
            F.col(idx(p.key)).alias("index"), F.col(rat(p.key)).alias("rating"),
        )
        cells[p.key] = F.when(F.col(idx(p.key)).isNotNull(), cell)
    return df.withColumns(cells).drop(*[idx(p.key) for p in properties], *[rat(p.key) for p in properties])


def project(df: DataFrame, columns, key: str = "value") -> DataFrame:
    """Replace struct cells by one of their fields; other columns, and structs without it, pass through."""
    projected = {
        f.name: F.col(f.name)[key]
        for f in df.schema.fields
        if f.name in columns and isinstance(f.dataType, T.StructType) and key in f.dataType.names
    }
    return df.withColumns(projected) if projected else df


def drop_all_null(df: DataFrame, columns) -> DataFrame:
    """Drop the columns without any value: one aggregate row decides."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def sub_table(df: DataFrame, columns, dataset=None, task=None, environment=None) -> DataFrame:
    """Rows of a data set, task or environment, without the columns that are empty there."""
    for name, value in (("dataset", dataset), ("task", task), ("environment", environment)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return drop_all_null(df, columns)
