"""Rating a whole table of measurements."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import band, double, quoted
from gaugewright.meta import DEFAULT_PROPERTIES, rateable
from gaugewright.operators.bounds import (
    collect_boundaries,
    complete_boundaries,
    fixed_boundaries,
    optimal_boundaries,
)
from gaugewright.operators.compound import SCORES, add_score_ratings, add_scores, score_boundaries
from gaugewright.operators.index import idx, index_best, rat, real_boundaries
from gaugewright.operators.reference import index_centered
from gaugewright.operators.share import share_independent
from gaugewright.session import materialize


class Rated(NamedTuple):
    database: DataFrame
    boundaries: DataFrame
    real_boundaries: DataFrame
    references: DataFrame | None


def add_ratings(df: DataFrame, bounds: dict, properties) -> DataFrame:
    """Rating column per property."""
    return df.withColumns({
        rat(p.key): F.expr(band(quoted(idx(p.key)), [double(b) for b in bounds[p.key]])) for p in properties
    })


def rate_cells(df: DataFrame, properties=DEFAULT_PROPERTIES, boundaries=None, mode="best", references=None):
    """Indices, boundaries (as a dict) and ratings before sharing: ``(cells, boundaries, references)``."""
    properties = rateable(df, properties)
    plain = df.drop(*_derived(properties))
    if mode == "best":
        indexed, references = index_best(plain, properties), None
    elif mode == "centered":
        indexed, references = index_centered(plain, properties, references)
    else:
        raise ValueError(f"unknown index mode {mode!r}")
    indexed = materialize(indexed)  # read by the boundaries, the ratings and the real boundaries
    if boundaries is None:
        boundaries = optimal_boundaries(indexed, properties)
    if isinstance(boundaries, DataFrame):
        boundaries = collect_boundaries(boundaries)
    bounds = complete_boundaries(boundaries, properties)
    return add_ratings(indexed, bounds, properties), bounds, references


def rate(
    df: DataFrame, properties=DEFAULT_PROPERTIES, boundaries=None, mode="best", references=None,
    rating_mode="optimistic mean",
) -> Rated:
    """Rate a measurement table.

    Already rated input is first reduced to its values, so rating is idempotent.  ``boundaries`` is a dict or
    a table (property, bounds); without it they are the quantiles of the indices.
    """
    properties = rateable(df, properties)
    cells, bounds, references = rate_cells(df, properties, boundaries, mode, references)
    real = real_boundaries(cells, bounds, properties)
    scored = materialize(add_scores(share_independent(cells, properties), properties, rating_mode))
    return Rated(
        add_score_ratings(scored), fixed_boundaries(df.sparkSession, bounds).unionByName(score_boundaries(scored)), real,
        references,
    )


def _derived(properties) -> list[str]:
    return (
        [idx(p.key) for p in properties] + [rat(p.key) for p in properties]
        + [f"{s}_index" for s in SCORES] + [f"{s}_rating" for s in SCORES]
    )
