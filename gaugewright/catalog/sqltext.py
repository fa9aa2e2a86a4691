"""Shared parts of the reference SQL."""

from __future__ import annotations

from gaugewright.meta import DEFAULT_PROPERTIES, PROPERTY_KEYS, Property

RUNS = """
runs AS (
 SELECT concat(l_orderkey,'_',l_linenumber,'_',l_partkey,'_',l_suppkey) AS log_name, p_brand AS dataset,
  l_returnflag AS task, concat('Arch ', l_linestatus) AS architecture, 'Engine 1.0' AS software,
  concat('M', l_suppkey % 10) AS model, 1 - l_discount AS accuracy, 1 - l_tax AS f1,
  CASE WHEN l_returnflag = 'N' AND l_suppkey % 10 = 3 THEN NULL ELSE l_quantity / 50 END AS precision,
  CASE WHEN l_returnflag = 'A' THEN (l_quantity + l_linenumber) / 57 END AS recall,
  CAST(l_linenumber * (l_suppkey % 10) AS DOUBLE) AS parameters, CAST(p_size AS DOUBLE) AS fsize,
  l_extendedprice / 50 AS train_power_draw, l_quantity AS train_running_time,
  l_extendedprice / 1000 AS power_draw, l_quantity / l_linenumber AS running_time
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

MEAS = f"""{RUNS}, meas AS (
 SELECT dataset, task, model, concat(architecture,' - ',software) AS environment,
  concat(task,' - ',dataset,' - ',model) AS configuration, count(*) AS n_results, min(log_name) AS log_name,
  {', '.join(f'round(avg({p}),9) AS {p}' for p in PROPERTY_KEYS)}
 FROM runs GROUP BY dataset, task, model, architecture, software)"""


def dbl(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def meta_values(properties: tuple[Property, ...] = DEFAULT_PROPERTIES) -> str:
    rows = ", ".join(
        f"('{p.key}', {i}, '{p.title}', '{p.shortname}', '{p.unit}', '{p.group}', {dbl(p.weight)}, {p.maximize}, {p.independent})"
        for i, p in enumerate(properties)
    )
    return (
        f"meta AS (SELECT * FROM (VALUES {rows}) AS t(property, pos, name, shortname, unit, grp, weight, maximize, independent))"
    )


META = meta_values()
G = "dataset, task, environment"


def index_case(value: str = "value", ref: str = "ref", maximize: str = "maximize") -> str:
    """Index of a value against a reference, with the shift of negative minimized references."""
    v = f"(CASE WHEN NOT {maximize} AND {ref} < 0 THEN {value} - {ref} + 1 ELSE {value} END)"
    r = f"(CASE WHEN NOT {maximize} AND {ref} < 0 THEN CAST(1 AS DOUBLE) ELSE {ref} END)"
    return (
        f"CASE WHEN {ref} IS NULL THEN NULL WHEN {value} IS NULL THEN CAST(0 AS DOUBLE) "
        f"WHEN isinf({v}) THEN CASE WHEN {maximize} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
        f"WHEN ({r} = 0 AND {maximize}) OR ({v} = 0 AND NOT {maximize}) THEN CAST(0 AS DOUBLE) "
        f"WHEN {maximize} THEN {v} / {r} ELSE {r} / {v} END"
    )


def band_case(index: str, bounds: str) -> str:
    return (
        f"CASE WHEN {index} IS NULL THEN NULL WHEN {index} > 100000 OR {index} <= -100 THEN 4 "
        f"WHEN {index} > {bounds}[1] THEN 0 WHEN {index} > {bounds}[2] THEN 1 "
        f"WHEN {index} > {bounds}[3] THEN 2 WHEN {index} > {bounds}[4] THEN 3 ELSE 4 END"
    )


def back_case(index: str, ref: str = "ref", maximize: str = "maximize") -> str:
    i = f"(CASE WHEN {index} = 0 THEN CAST(0.001 AS DOUBLE) ELSE {index} END)"
    return f"CASE WHEN {maximize} THEN {i} * {ref} ELSE {ref} / {i} END"


def quantiles(value: str) -> str:
    return (
        f"list_transform(quantile_cont({value}, [0.8, 0.6, 0.4, 0.2]), lambda b : round(CAST(b AS DOUBLE), 9))"
    )


def unpivot(source: str = "meas") -> str:
    return f"(SELECT * FROM {source} UNPIVOT INCLUDE NULLS (value FOR property IN ({', '.join(PROPERTY_KEYS)})))"


def cells(source: str = "meas", meta: str = META, keys: str = G) -> str:
    return f"""{meta}, cells AS (
 SELECT * FROM (SELECT u.*, m.pos, m.grp, m.weight, m.maximize, m.independent,
  count(u.value) OVER (PARTITION BY {', '.join('u.' + k.strip() for k in keys.split(','))}, u.property) AS group_count
 FROM {unpivot(source)} u JOIN meta m ON u.property = m.property))"""


INDEXED = f"""{MEAS}, {cells()}, indexed AS (
 SELECT *, round({index_case()} + CAST(1e-12 AS DOUBLE), 9) AS index FROM (
  SELECT *, CASE WHEN maximize THEN max(value) OVER w ELSE min(value) OVER w END AS ref FROM cells
  WINDOW w AS (PARTITION BY {G}, property)))"""

BOUNDED = f"""{INDEXED}, bounds AS (
 SELECT property, {quantiles('index')} AS bounds FROM indexed WHERE index IS NOT NULL GROUP BY property)"""

# cells with rating, before sharing
RATED0 = f"""{BOUNDED}, rated0 AS (
 SELECT i.*, {band_case('i.index', 'b.bounds')} AS rating, b.bounds FROM indexed i LEFT JOIN bounds b ON i.property = b.property)"""


def shared(source: str = "rated0", out: str = "rated") -> str:
    """Sharing pass; the test tables have two environments, so the environment belongs to the group."""
    order = "row(configuration, environment)"
    first = "arg_min({c}, CASE WHEN value IS NOT NULL THEN configuration END) OVER w"
    return f"""{out} AS (
 SELECT * EXCLUDE (value, index, rating, n_all, n_have, v1, i1, r1),
  CASE WHEN independent AND n_have > 0 AND n_have < n_all THEN v1 ELSE value END AS value,
  CASE WHEN independent AND n_have > 0 AND n_have < n_all THEN i1 ELSE index END AS index,
  CASE WHEN independent AND n_have > 0 AND n_have < n_all THEN r1 ELSE rating END AS rating
 FROM (SELECT *, count(*) OVER w AS n_all, count(value) OVER w AS n_have, {first.format(c='value')} AS v1,
   {first.format(c='index')} AS i1, {first.format(c='rating')} AS r1
  FROM {source} WINDOW w AS (PARTITION BY dataset, model, environment, property)))"""


RATED = f"{RATED0}, {shared()}"


def mean_of(where: str = "true") -> str:
    return (
        f"round(coalesce(sum(CASE WHEN weight > 0 AND index IS NOT NULL AND {where} THEN weight * index END)"
        f" / nullif(sum(CASE WHEN weight > 0 AND index IS NOT NULL AND {where} THEN weight END), 0), 0) + CAST(1e-12 AS DOUBLE), 9)"
    )


def scores(source: str = "rated", out: str = "scored") -> str:
    return f"""{out} AS (
 SELECT configuration, {G}, model, {mean_of()} AS compound_index, {mean_of("grp = 'Performance'")} AS quality_index,
  {mean_of("grp <> 'Performance'")} AS resource_index
 FROM {source} GROUP BY configuration, {G}, model)"""


SCORED = f"{RATED}, {scores()}"


def score_ratings(source: str = "scored", out: str = "score_rated") -> str:
    parts = ", ".join(
        band_case(f"{s}_index", f"{s}_b") + f" AS {s}_rating" for s in ("compound", "quality", "resource")
    )
    bounds = ", ".join(f"{quantiles(f'{s}_index')} AS {s}_b" for s in ("compound", "quality", "resource"))
    return f"""{out} AS (
 SELECT s.*, {parts} FROM {source} s JOIN (SELECT {G}, {bounds} FROM {source} GROUP BY {G}) USING ({G}))"""


SCORE_RATED = f"{SCORED}, {score_ratings()}"
