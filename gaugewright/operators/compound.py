"""Weighted combination of the indices of one row, and ratings of the combined scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import band, double, quoted, settle
from gaugewright.meta import GROUP_KEYS, QUANTILES
from gaugewright.operators.bounds import rounded
from gaugewright.operators.index import idx
from gaugewright.operators.joins import join_groups
from gaugewright.operators.quantiles import exact_quantiles

SCORES = ("compound", "quality", "resource")


def weighted_mean(items: list[tuple[str, float]]) -> str:
    total = " + ".join(f"coalesce({c} * {double(w)}, 0D)" for c, w in items)
    weight = " + ".join(f"if({c} IS NULL, 0D, {double(w)})" for c, w in items)
    return f"try_divide({total}, {weight})"


def weighted_median(items: list[tuple[str, float]]) -> str:
    """Descending weighted median that stays on the element before the crossing of one half."""
    entries = ", ".join(f"named_struct('v', {c}, 'pos', {pos}, 'w', {double(w)})" for pos, (c, w) in enumerate(items))
    ordered = f"sort_array(filter(array({entries}), e -> e.v IS NOT NULL), false)"

    def share(n: str) -> str:
        return f"round(try_divide(aggregate(slice(o, 1, {n}), 0D, (a, e) -> a + e.w), aggregate(o, 0D, (a, e) -> a + e.w)), 12)"

    steps = (
        f"transform(o, (e, i) -> named_struct('v', e.v, 'next_v', get(o, i + 1).v, 'c', {share('i + 1')}, 'next_c', {share('i + 2')}))"
    )
    crossing = f"filter({steps}, s -> s.c >= 0.5D OR s.next_c > 0.5D)"
    picked = f"get(transform({crossing}, s -> if(s.c = 0.5D, (s.v + s.next_v) / 2, s.v)), 0)"
    return f"get(transform(array({ordered}), o -> {picked}), 0)"  # the sorted array is bound once


def combine(items: list[tuple[str, float]], mode: str = "optimistic mean") -> str:
    """One score from weighted indices; missing indices and weights that are not positive do not count."""
    items = [(c, float(w)) for c, w in items if w > 0]
    if mode not in ("best", "worst") and "median" not in mode and "mean" not in mode:
        raise ValueError(f"unknown rating mode {mode!r}")
    if not items:
        return "0D"
    if mode in ("best", "worst"):
        names = ", ".join(c for c, _ in items)
        score = f"{'greatest' if mode == 'best' else 'least'}({names})" if len(items) > 1 else names
    elif "median" in mode:
        score = weighted_median(items)
    else:
        score = weighted_mean(items)
    return f"coalesce({score}, 0D)"


def combine_custom(values: list[tuple[str, float]]) -> str:
    """Weighted mean of plain values with given weights: nothing is skipped, a missing value gives NULL."""
    return f"({' + '.join(f'{c} * {double(w)}' for c, w in values)}) / {double(sum(w for _, w in values))}"


def add_scores(df: DataFrame, properties, mode: str = "optimistic mean") -> DataFrame:
    """Compound, quality (group Performance) and resource (all other groups) index per row."""
    def score(chosen):
        return F.expr(settle(combine([(quoted(idx(p.key)), p.weight) for p in chosen], mode)))

    return df.withColumns({
        "compound_index": score(properties),
        "quality_index": score([p for p in properties if p.group == "Performance"]),
        "resource_index": score([p for p in properties if p.group != "Performance"]),
    })


def long_scores(df: DataFrame, keep) -> DataFrame:
    cells = ", ".join(f"named_struct('property', '{s}_index', 'index', {s}_index)" for s in SCORES)
    return df.selectExpr(*[quoted(k) for k in keep], f"inline(array({cells}))")


def score_boundaries(df: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Published boundaries of the three scores over the whole table."""
    found = exact_quantiles(long_scores(df, []), ["property"], "index", quantiles, "bounds")
    return found.select("property", rounded("bounds").alias("bounds"))


def group_score_boundaries(df: DataFrame, keys=GROUP_KEYS, quantiles=QUANTILES) -> DataFrame:
    """Boundaries of the three scores inside each group, one column per score."""
    found = exact_quantiles(long_scores(df, keys), [*keys, "property"], "index", quantiles, "bounds")
    found = found.withColumn("bounds", rounded("bounds"))
    return found.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN property = '{s}_index' THEN bounds END) AS {s}__bounds") for s in SCORES]
    )


def add_score_ratings(df: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    joined = join_groups(df, group_score_boundaries(df, keys), keys)
    return joined.withColumns({
        f"{s}_rating": F.expr(band(f"{s}_index", [f"{s}__bounds[{i}]" for i in range(4)])) for s in SCORES
    }).drop(*[f"{s}__bounds" for s in SCORES])
