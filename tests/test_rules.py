"""Hand-computed cases of the index, rating and compound rules."""

import math

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import names as N
from gaugewright.functions import units as U
from gaugewright.functions.scalars import band, index_to_value, scaled_index, value_to_index
from gaugewright.operators.compound import combine, combine_custom
from gaugewright.operators.scores import in_top_k

INF = float("inf")


def text(x):
    """A number as SQL text."""
    if x is None:
        return "CAST(NULL AS DOUBLE)"
    return f"double('{x}')"


def value(spark, column, **columns):
    column = F.expr(column) if isinstance(column, str) else column
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column.alias("r")).first()["r"]


def number(x):
    return F.lit(None).cast("double") if x is None else F.lit(float(x))


@pytest.mark.parametrize("v,ref,maximize,want", [
    (0.8, 1.0, True, 0.8), (2.0, 1.0, False, 0.5), (INF, 5.0, True, 1.0), (INF, 5.0, False, 0.0), (-INF, 5.0, True, 1.0),
    (None, 1.0, True, 0.0), (3.0, 0.0, True, 0.0), (0.0, 3.0, False, 0.0), (5.0, 0.0, False, 0.0), (3.0, 2.0, True, 1.5),
    (1.0, None, True, None),
])
def test_value_to_index(spark, v, ref, maximize, want):
    assert value(spark, value_to_index(text(v), text(ref), maximize)) == want


@pytest.mark.parametrize("v,ref,maximize,want", [
    (-5.0, -5.0, False, 1.0), (-4.0, -5.0, False, 0.5), (-1.0, -5.0, False, 0.2), (-4.0, -2.0, True, 2.0), (None, -5.0, False, 0.0),
])
def test_negative_references(spark, v, ref, maximize, want):
    assert value(spark, scaled_index(text(v), text(ref), maximize)) == want


@pytest.mark.parametrize("index,want", [
    (0.95, 0), (0.9, 1), (0.85, 1), (0.8, 2), (0.7, 3), (0.6, 4), (0.0, 4), (-100.0, 4), (100001.0, 4), (100000.0, 0), (None, None),
])
def test_bands(spark, index, want):
    assert value(spark, band(text(index), ["0.9D", "0.8D", "0.7D", "0.6D"])) == want


def test_index_to_value(spark):
    assert value(spark, index_to_value('0.5D', '10D', True)) == 5
    assert value(spark, index_to_value('0.5D', '10D', False)) == 20
    assert value(spark, index_to_value('0D', '10D', False)) == 10000
    for x in (0.3, 1.0, 7.5):
        index = f"({value_to_index(text(x), '2.5D', False)})"
        assert math.isclose(value(spark, index_to_value(index, '2.5D', False)), x)


@pytest.mark.parametrize("mode,items,want", [
    ("best", [(0.2, 1), (0.9, 1), (0.5, 1)], 0.9),
    ("worst", [(0.2, 1), (0.9, 1), (0.5, 1)], 0.2),
    ("optimistic mean", [(0.2, 1), (0.8, 3)], 0.65),
    ("pessimistic mean", [(0.2, 1), (None, 3), (0.4, 1)], 0.3),
    ("mean", [(0.2, 0), (0.4, -1)], 0.0),
    ("mean", [(None, 1)], 0.0),
    ("mean", [], 0.0),
    # cumulative weights 1/4, 1/2: the mean of second and third
    ("median", [(0.9, 1), (0.7, 1), (0.5, 1), (0.3, 1)], 0.6),
    # cumulative weights 1/3, 2/3: stays on the element before the crossing
    ("median", [(0.9, 1), (0.7, 1), (0.5, 1)], 0.9),
    ("median", [(0.9, 3), (0.7, 1)], 0.9),
    ("median", [(0.4, 1)], 0.4),
])
def test_combine(spark, mode, items, want):
    assert value(spark, combine([(text(v), w) for v, w in items], mode)) == pytest.approx(want, abs=1e-12)


def test_combine_rejects_unknown_modes(spark):
    with pytest.raises(ValueError):
        combine([("1D", 1)], "geometric")


def test_custom_weights_do_not_skip(spark):
    assert value(spark, combine_custom([('0.5D', 1.0), ('1D', 3.0)])) == 0.875
    assert value(spark, combine_custom([('0.5D', 1.0), (text(None), 3.0)])) is None


@pytest.mark.parametrize("cpu,want", [
    ("13th Gen Intel(R) Core(TM) i9-13900K", "Intel i9-13900K"),
    ("Intel(R) Core(TM) i7-6700 CPU @ 3.40GHz", "Intel i7-6700"),
    ("Intel(R) Core(TM) i7-10610U CPU @ 1.80GHz", "Intel i7-10610U"),
    ("ARMv8 Processor rev 1 (v8l)", "ARMv8 rev 1 (v8l)"),
    ("AMD Ryzen 7 3700X 8-Core Processor", "AMD Ryzen 7 3.."),
    ("An AMD Ryzen 7 3700X", "AMD 7"),
])
def test_hardware_names(spark, cpu, want):
    assert value(spark, N.hardware_name(F.col("c")), c=cpu) == want


def test_software(spark):
    reqs = F.array(F.lit("numpy==1.0"), F.lit("SCIKIT_learn==1.4.0"), F.lit("scikit-learn==9"))
    assert value(spark, N.software_name("Scikit-learn", reqs)) == "Scikit-learn 1.4.0"
    assert value(spark, N.software_name("Other", reqs)) == "Other n.a."


@pytest.mark.parametrize("x", [0.0001, 0.5, 12.3456789, 999.99999, 1000, 1365, 1375, 123456, 0.00001234, -3.5, 0, 9.999e9, 99950, 1e-12])
def test_number_text(spark, x):
    """The same text as printing with Python's formats."""
    want = f"{x:7.6f}"[:7] if 0.0001 <= x < 1000 else f"{x:.2e}".replace("e+0", "e+").replace("e-0", "e-")
    assert value(spark, U.format_number(number(x))) == want


def test_units(spark):
    shown, unit = U.format_measure(F.col("v"), "wattseconds")
    assert value(spark, F.concat_ws(" ", shown, unit), v=1234567.0) == "1.23456 [MWs]"
    assert value(spark, F.concat_ws(" ", shown, unit), v=0.0025) == "2.50000 [mWs]"
    missing, name = U.format_measure(number(None), "seconds")
    assert value(spark, F.concat_ws(" ", missing, name)) == "N.A. seconds"
    same, percent = U.format_measure(F.col("v"), "percent")
    assert value(spark, F.concat_ws(" ", same, percent), v=2500.0) == "2.50e+3 [%]"


def test_top_k(spark):
    scores = F.array(*[F.lit(float(s)) for s in (0.1, 0.4, 0.4, 0.05, 0.05)])
    hits = [value(spark, in_top_k(scores, F.lit(label), 2)) for label in range(5)]
    assert hits == [False, True, True, False, False]
    assert value(spark, in_top_k(scores, F.lit(3), 5)) is True
