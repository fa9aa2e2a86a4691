"""Rating boundaries: optimal quantiles, intervals, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.scalars import DIGITS
from gaugewright.meta import BOTTOM, DEFAULT_BOUNDS, QUANTILES, TOP
from gaugewright.operators.index import long_cells
from gaugewright.operators.quantiles import exact_quantiles


def rounded(bounds: str):
    return F.expr(f"transform({bounds}, b -> round(b, {DIGITS}))")


def optimal_boundaries(df: DataFrame, properties, quantiles=QUANTILES) -> DataFrame:
    """Quantiles of every property's index over the whole table: ``(property, bounds)``."""
    cells = long_cells(df, properties, [], ("index",))
    found = exact_quantiles(cells, ["property"], "index", quantiles, "bounds")
    return found.select("property", rounded("bounds").alias("bounds"))


def fixed_boundaries(spark: SparkSession, bounds: dict[str, list[float]]) -> DataFrame:
    return spark.createDataFrame(
        [(k, [float(x) for x in v]) for k, v in bounds.items()], "property string, bounds array<double>"
    )


def collect_boundaries(bounds: DataFrame) -> dict[str, list[float]]:
    """The boundary table as a dict: one row of four numbers per property."""
    return {r["property"]: list(r["bounds"]) for r in bounds.collect()}


def complete_boundaries(bounds: dict, properties, default=DEFAULT_BOUNDS) -> dict[str, list[float]]:
    """Boundaries for every property: the given ones, else those under ``default``, else the standard ones."""
    fallback = list(bounds.get("default", default))
    return {p.key: [float(b) for b in bounds.get(p.key, fallback)] for p in properties}


def intervals(bounds: DataFrame) -> DataFrame:
    """Bands as ``(upper, lower)`` rows, best band first."""
    edges = F.concat(F.array(F.lit(TOP)), F.col("bounds"), F.array(F.lit(BOTTOM)))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("bounds")),
        lambda i: F.struct(i.alias("band"), edges[i].alias("upper"), edges[i + 1].alias("lower")),
    )
    return bounds.select("property", F.inline(pairs))


def intervals_to_bounds(bands: DataFrame) -> DataFrame:
    """Boundaries again from (possibly hand-edited) intervals: the upper edge of every band but the first."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("band") > 0, F.struct("band", "upper"))))
    return bands.groupBy("property").agg(F.transform(ordered, lambda e: e["upper"]).alias("bounds"))


def boundaries_to_json(bounds: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("property", "bounds")))
    return bounds.agg(F.to_json(F.map_from_entries(entries)).alias("boundaries"))


def boundaries_from_json(text: DataFrame, column: str = "boundaries") -> DataFrame:
    return text.select(F.explode(F.from_json(column, "map<string,array<double>>")).alias("property", "bounds"))
