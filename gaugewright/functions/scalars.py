"""Expressions for indices, ratings and missing values.

The index rules are SQL text over column names: one text per property reaches the JVM in one call, while the
same rule built operator by operator takes dozens of calls per property and dominates short jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewright.meta import BOTTOM, TOP

# Fixed value: stands in for an index of zero when it is turned back into a value.
ZERO_INDEX = 10e-4
DIGITS = 9
TIE = 1e-12


def quoted(name: str) -> str:
    return f"`{name}`"


def double(x: float) -> str:
    return f"{float(x)!r}D"


def settle(text: str) -> str:
    """Round an index or score.  Ratios and means of rounded numbers often end in exactly half a digit, where
    the last bit would decide; the offset settles such ties upwards."""
    return f"round({text} + {double(TIE)}, {DIGITS})"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out one time; written out in full it is worked out at every place it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def value_to_index(value: str, ref: str, maximize: bool) -> str:
    """Relative index of a value; a missing value has index 0, a missing reference gives NULL."""
    infinite, zero, ratio = (
        ("1D", f"{ref} = 0", f"{value} / {ref}") if maximize else ("0D", f"{value} = 0", f"{ref} / {value}")
    )
    return (
        f"CASE WHEN {ref} IS NULL THEN NULL WHEN {value} IS NULL THEN 0D "
        f"WHEN abs({value}) = double('Infinity') THEN {infinite} WHEN {zero} THEN 0D ELSE {ratio} END"
    )


def scaled_index(value: str, ref: str, maximize: bool) -> str:
    """Index as stored in a rated cell: negative references of minimized properties are shifted to 1."""
    index = value_to_index(value, ref, maximize)
    if not maximize:
        index = f"CASE WHEN {ref} < 0 THEN {value_to_index(f'({value} - {ref} + 1D)', '1D', False)} ELSE {index} END"
    return settle(index)


def index_to_value(index: str, ref: str, maximize: bool) -> str:
    usable = f"if({index} = 0, {double(ZERO_INDEX)}, {index})"
    return f"{usable} * {ref}" if maximize else f"{ref} / {usable}"


def band(index: str, bounds: list[str]) -> str:
    """Rating 0 (best) to 4 of an index against four descending boundaries."""
    steps = " ".join(f"WHEN {index} > {b} THEN {rating}" for rating, b in enumerate(bounds))
    return (
        f"CASE WHEN {index} IS NULL THEN NULL WHEN {index} > {double(TOP)} OR {index} <= {double(BOTTOM)} THEN 4 {steps} ELSE 4 END"
    )


def letter(rating: Column) -> Column:
    return F.substring(F.lit("ABCDE"), rating + 1, F.lit(1))


def short_environment(environment: Column) -> Column:
    return F.split_part(environment, F.lit(" - "), F.lit(1))


def clip01(col: Column) -> Column:
    return F.greatest(F.least(col, F.lit(1.0)), F.lit(0.0))


def safe_corr(a, b) -> Column:
    """Pearson correlation that is NULL, not an error, for a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
