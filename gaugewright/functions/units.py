"""Number and unit formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewright.functions.scalars import once

# SI prefixes by thousands, unit symbols, and units that are never rescaled.
PREFIXES = ["q", "r", "y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y", "R", "Q"]
ZERO_PREFIX = 10
SYMBOLS = {
    "number": "#", "percent": "%", "seconds": "s", "wattseconds": "Ws", "watt": "W", "watthours": "Wh",
    "joule": "J", "byte": "B", "FLOPS": "FLOPS",
}
DIMENSIONLESS = ("number", "percent", "FLOPS")


def unit_step(value: Column, unit: str) -> Column:
    """Power of 1000 that brings the magnitude into [1, 1000); 0 for zero, missing and dimensionless units."""
    if unit in DIMENSIONLESS:
        return F.lit(0)
    size = F.abs(value)
    step = F.floor(F.round(F.log10(size), 9) / 3).cast("int")
    step = F.greatest(F.least(step, F.lit(len(PREFIXES) - 1 - ZERO_PREFIX)), F.lit(-ZERO_PREFIX))
    return F.when((size > 0) & (size < float("inf")), step).otherwise(F.lit(0))


def scale_to(value: Column, step: Column) -> Column:
    """The value in the unit of that step."""
    return value / F.pow(F.lit(1000.0), step)


def unit_symbol(step: Column, unit: str, brackets: bool = True) -> Column:
    prefix = F.array(*[F.lit(p) for p in PREFIXES])[step + ZERO_PREFIX]
    symbol = F.concat(prefix, F.lit(SYMBOLS.get(unit, unit)))
    return F.concat(F.lit("["), symbol, F.lit("]")) if brackets else symbol


def scientific(value: Column) -> Column:
    """Two decimals in short scientific text; exact halves go to the even digit."""
    size = F.abs(value)
    exponent = F.floor(F.log10(size)).cast("int")
    # 900 mantissas (100 to 999) per exponent in one number: a mantissa of 1000 carries by itself
    place = exponent * 900 + F.rint(size / F.pow(F.lit(10.0), exponent - 2)).cast("long") - 100

    def text(at: Column) -> Column:
        return F.concat(
            F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
            F.overlay((F.pmod(at, F.lit(900)) + 100).cast("string"), F.lit("."), F.lit(2), F.lit(0)),
            F.when(at < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(F.floor(at / 900)).cast("string"),
        )

    return F.when(value == 0, F.lit("0.00e+0")).otherwise(once(place, text))


def format_number(value: Column) -> Column:
    """Seven characters for ordinary numbers, short scientific text for the rest."""
    plain = F.substring(F.format_string("%7.6f", value), 1, 7)
    return F.when(value.isNull(), F.lit("N.A.")).when((value < 1000) & (value >= 0.0001), plain).otherwise(scientific(value))


def format_measure(value: Column, unit: str) -> tuple[Column, Column]:
    """Formatted value and unit symbol; a missing value keeps the unit's name."""
    step = unit_step(value, unit)
    text = format_number(scale_to(value.cast("double"), step))
    symbol = F.when(value.isNull(), F.lit(unit)).otherwise(unit_symbol(step, unit))
    return text, symbol
