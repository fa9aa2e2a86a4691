"""Exact order statistics per key without sorting a whole key in one task.

Values are counted per distinct value (partial aggregation collapses copies), the counts are summed per
logarithmic bucket, and only the buckets that hold a wanted rank are ordered.  A key that holds a third of
all rows is therefore spread over as many tasks as it has distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups
from gaugewright.session import materialize

# A bucket spans a factor of 2**(1/16384), so values of nine significant digits put at most
# 42,400 distinct values into one bucket, and one power of two needs at most 16,384 histogram rows.
BUCKETS_PER_OCTAVE = 1 << 14
_OFFSET = 1075 * BUCKETS_PER_OCTAVE + 1
_INFINITE = 1 << 40


def value_bucket(value: str) -> str:
    """Order-preserving bucket number of a double."""
    size = f"CAST(floor(log2(abs({value})) * {BUCKETS_PER_OCTAVE}) AS BIGINT) + {_OFFSET}L"
    return (
        f"CASE WHEN {value} = 0 THEN 0L WHEN abs({value}) = double('Infinity') THEN CAST(sign({value}) AS BIGINT) * {_INFINITE}L "
        f"WHEN {value} > 0 THEN {size} ELSE -({size}) END"
    )


def exact_positions(
    df: DataFrame, keys: list[str], value: str, positions: list[Callable[[str], str]], out: str = "q",
    bucket: Callable[[str], str] = value_bucket,
) -> DataFrame:
    """Per key an array with the value at each (fractional) zero-based position of the ascending order.

    A position is SQL text from the name of the key's row count; fractional positions are interpolated
    linearly.  NULL values are left out.  ``bucket`` is any function of the value that keeps its order.
    """
    keys = list(keys)
    own_key = not keys
    if own_key:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.expr(bucket("_v")))
    )
    histogram = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    found = pick_positions(histogram, lambda hit: counted, keys, positions, out)
    return found.drop("_all") if own_key else found


COARSE = 256  # buckets that the first reading of stored rows counts as one


def stored_quantiles(df: DataFrame, keys: list[str], value: str, probs, out: str = "q") -> DataFrame:
    """`exact_quantiles` of rows that are stored, read twice.

    The first reading counts rows in wide buckets, which tasks hold few of; the second counts the values in those wide
    buckets only that have a wanted rank. So no task holds the distinct values of a key, and few rows are shuffled.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", F.expr(value_bucket("_v")))
    wide = F.floor(F.col("_b") / COARSE)
    coarse = rows.groupBy(*keys, wide.alias("_w")).agg(F.count("*").alias("_wc"))
    by = ", ".join(f"`{k}`" for k in keys)
    placed = coarse.selectExpr(
        "*", f"sum(_wc) OVER (PARTITION BY {by} ORDER BY _w ROWS UNBOUNDED PRECEDING) AS _stop", f"sum(_wc) OVER (PARTITION BY {by}) AS _n"
    )
    positions = quantile_positions(probs)
    ranks = [f"{end}(round(CAST({p('_n')} AS DOUBLE), 9))" for p in positions for end in ("floor", "ceil")]
    wanted = " OR ".join(f"({r} >= _stop - _wc AND {r} < _stop)" for r in ranks)
    placed = materialize(placed.selectExpr(*keys, "_w", "_wc", f"{wanted} AS _wanted"))  # a few thousand rows a key at most
    inside = placed.filter("_wanted").select(*keys, "_w")
    counted = materialize(
        join_groups(rows.withColumn("_w", wide), inside, [*keys, "_w"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    )
    others = placed.filter("NOT _wanted").select(*keys, (F.col("_w") * COARSE).alias("_b"), F.col("_wc").alias("_bc"))
    histogram = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc")).unionByName(others)
    return pick_positions(histogram, lambda hit: counted, keys, positions, out)


def pick_positions(
    histogram: DataFrame, counted: Callable[[DataFrame], DataFrame], keys: list[str], positions: list[Callable[[str], str]], out: str = "q",
) -> DataFrame:
    """The values at the positions from counts per bucket ``(keys, _b, _bc)``.

    ``counted`` gives the counts per value ``(keys, _b, _v, _c)``, at least those of the buckets ``(keys, _b)`` that it is handed.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    histogram = histogram.selectExpr(
        "*", f"sum(_bc) OVER (PARTITION BY {by} ORDER BY _b ROWS UNBOUNDED PRECEDING) AS _end", f"sum(_bc) OVER (PARTITION BY {by}) AS _n"
    )
    pos = [f"round(CAST({p('_n')} AS DOUBLE), 9)" for p in positions]
    ranks = list(dict.fromkeys(r for p in pos for r in (f"floor({p})", f"ceil({p})")))

    def covers(start: str, end: str) -> str:
        return " OR ".join(f"({r} >= {start} AND {r} < {end})" for r in ranks)

    hit = histogram.filter(covers("(_end - _bc)", "_end")).selectExpr(*keys, "_b", "_n", "_end - _bc AS _before")
    found = (
        join_groups(counted(hit), hit, [*keys, "_b"], "inner")
        .selectExpr("*", f"_before + sum(_c) OVER (PARTITION BY {by}, _b ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _stop")
        .selectExpr("*", "_stop - _c AS _start").filter(covers("_start", "_stop"))
    )
    at = [F.expr(f"max(CASE WHEN {r} >= _start AND {r} < _stop THEN _v END) AS _r{i}") for i, r in enumerate(ranks)]
    picked = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *at)
    ends = [(f"_r{ranks.index(f'floor({p})')}", f"_r{ranks.index(f'ceil({p})')}") for p in pos]
    values = ", ".join(
        f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({p} - floor({p})) END" for p, (lo, hi) in zip(pos, ends)
    )
    return picked.selectExpr(*[f"`{k}`" for k in keys], f"array({values}) AS `{out}`")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs, out: str = "q") -> DataFrame:
    """Linearly interpolated quantiles per key as an array."""
    return exact_positions(df, keys, value, quantile_positions(probs), out)


def quantile_positions(probs) -> list[Callable[[str], str]]:
    return [lambda n, p=p: f"{float(p)!r}D * ({n} - 1)" for p in probs]
