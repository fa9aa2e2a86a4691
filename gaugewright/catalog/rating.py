"""Queries: merging, indices, boundaries, ratings, compound scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.functions.scalars import DIGITS, index_to_value, scaled_index, settle
from gaugewright.meta import DEFAULT_PROPERTIES as PROPS
from gaugewright.meta import GROUP_KEYS, PROPERTY_KEYS, with_weights
from gaugewright.operators import bounds as B
from gaugewright.operators import compound as C
from gaugewright.operators.index import idx, index_best, long_cells, rat, real_boundaries
from gaugewright.operators.kept import add_batch, kept_boundaries
from gaugewright.operators.merge import merge_runs
from gaugewright.operators.reference import index_centered, optimal_references
from gaugewright.operators.share import share_independent
from gaugewright.plans.rate import rate, rate_cells
from gaugewright.session import materialize, new_stage
from gaugewright.sources.views import measurements, runs, table

ROW = ["dataset", "task", "environment", "model"]



_props = ", ".join(PROPERTY_KEYS)


@query("merge_runs", f"WITH {S.MEAS} SELECT dataset, task, environment, model, configuration, n_results, log_name, {_props} FROM meas")
def merged(spark, sf):
    return merge_runs(runs(spark, sf), digits=DIGITS).select(*ROW, "configuration", "n_results", "log_name", *PROPERTY_KEYS)


@query("index_best", f"WITH {S.INDEXED} SELECT {S.G}, model, property, value, index FROM indexed WHERE index IS NOT NULL")
def best_indices(spark, sf):
    return long_cells(index_best(measurements(spark, sf), PROPS), PROPS, ROW).filter("index IS NOT NULL")


_RUN_REFS = ", ".join(
    f"{'max' if p.maximize else 'min'}({p.key}) OVER w AS {p.key}__ref" for p in PROPS
)
_RUN_IDX = ", ".join(
    f"round(sum(round({S.index_case(p.key, p.key + '__ref', 'true' if p.maximize else 'false')} + CAST(1e-12 AS DOUBLE), 9)), 4) AS {p.key}" for p in PROPS
)


@query("index_raw_runs", f"""WITH {S.RUNS}, r AS (SELECT *, {_RUN_REFS} FROM runs
 WINDOW w AS (PARTITION BY dataset, task, architecture, software)) SELECT dataset, model, count(*) AS n, {_RUN_IDX} FROM r GROUP BY dataset, model""")
def raw_run_indices(spark, sf):
    """Every single run (not merged) against the best run of its group, summed per data set and model."""
    keys = ("dataset", "task", "architecture", "software")
    from gaugewright.operators.index import add_indices, best_references
    raw = runs(spark, sf)
    indexed = add_indices(raw, best_references(raw, PROPS, keys), PROPS, keys)
    return indexed.groupBy("dataset", "model").agg(
        F.count("*").alias("n"), *[F.round(F.sum(idx(p)), 4).alias(p) for p in PROPERTY_KEYS]
    )


@query("index_negative", f"""SELECT c_custkey, c_mktsegment, c_acctbal, ref, round({S.index_case('c_acctbal', 'ref', 'false')} + CAST(1e-12 AS DOUBLE), 9) AS index
 FROM (SELECT *, min(c_acctbal) OVER (PARTITION BY c_mktsegment) AS ref FROM customer)""")
def negative_reference(spark, sf):
    customer = table(spark, sf, "customer")
    refs = customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("ref"))
    return customer.join(refs, "c_mktsegment").select(
        "c_custkey", "c_mktsegment", "c_acctbal", "ref",
        F.expr(scaled_index("c_acctbal", "ref", False)).alias("index"),
    )


@query("index_to_value", f"""WITH {S.INDEXED} SELECT {S.G}, model, property, round({S.back_case('index')} + CAST(1e-9 AS DOUBLE), 6) AS value
 FROM indexed WHERE index IS NOT NULL""")
def indices_to_values(spark, sf):
    from gaugewright.operators.index import best_references
    meas = measurements(spark, sf)
    indexed = index_best(meas, PROPS).join(best_references(meas, PROPS), list(GROUP_KEYS))
    cells = F.array(*[
        F.struct(
            F.lit(p.key).alias("property"), F.col(idx(p.key)).alias("index"),
            r6(F.expr(index_to_value(idx(p.key), f"{p.key}__ref", p.maximize))).alias("value"),
        )
        for p in PROPS
    ])
    return indexed.select(*ROW, F.inline(cells)).filter("index IS NOT NULL").drop("index")


def _split_bounds(df, extra=("property",)):
    return df.select(*extra, *[F.col("bounds")[i].alias(f"b{i}") for i in range(4)])


_b4 = ", ".join(f"bounds[{i + 1}] AS b{i}" for i in range(4))


@query("boundaries", f"WITH {S.BOUNDED} SELECT property, {_b4} FROM bounds")
def boundaries(spark, sf):
    return _split_bounds(B.optimal_boundaries(index_best(measurements(spark, sf), PROPS), PROPS))


@query("boundaries_incremental", f"WITH {S.BOUNDED} SELECT property, {_b4} FROM bounds")
def boundaries_by_batches(spark, sf):
    """Measurements in three batches; models of one group come in different ones, so that references change."""
    path = new_stage(spark)
    rows = materialize(measurements(spark, sf)).withColumn("_part", F.pmod(F.xxhash64(*ROW, "configuration"), F.lit(3)))
    for batch in range(3):
        add_batch(rows.filter(F.col("_part") == batch), path, batch, PROPS)
    return _split_bounds(kept_boundaries(spark, path))


@query("boundary_intervals", f"""WITH {S.BOUNDED}, edges AS (
 SELECT property, list_concat(list_concat([CAST(100000 AS DOUBLE)], bounds), [CAST(-100 AS DOUBLE)]) AS e FROM bounds
 UNION ALL SELECT 'default', [CAST(x AS DOUBLE) FOR x IN [100000, 0.9, 0.8, 0.7, 0.6, -100]])
SELECT property, CAST(i AS INTEGER) AS band, e[i + 1] AS upper, e[i + 2] AS lower
FROM edges, range(5) AS t(i)""")
def boundary_intervals(spark, sf):
    found = B.optimal_boundaries(index_best(measurements(spark, sf), PROPS), PROPS)
    default = B.fixed_boundaries(spark, {"default": [0.9, 0.8, 0.7, 0.6]})
    return B.intervals(found.unionByName(default))


@query("boundaries_json", f"WITH {S.BOUNDED} SELECT property, {_b4} FROM bounds")
def boundaries_round_trip(spark, sf):
    found = B.optimal_boundaries(index_best(measurements(spark, sf), PROPS), PROPS)
    return _split_bounds(B.boundaries_from_json(B.boundaries_to_json(found)))


@query("rate_bands", f"""WITH {S.INDEXED} SELECT property,
 {S.band_case('index', '[CAST(0.9 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.6 AS DOUBLE)]')} AS rating, count(*) AS n
 FROM indexed WHERE index IS NOT NULL GROUP BY ALL""")
def default_bands(spark, sf):
    from gaugewright.functions.scalars import band
    cells = long_cells(index_best(measurements(spark, sf), PROPS), PROPS, [], ("index",)).filter("index IS NOT NULL")
    rating = F.expr(band("index", ["0.9D", "0.8D", "0.7D", "0.6D"]))
    return cells.groupBy("property", rating.alias("rating")).agg(F.count("*").alias("n"))


@query("property_ratings", f"WITH {S.RATED0} SELECT {S.G}, model, property, index, rating FROM rated0 WHERE index IS NOT NULL")
def property_ratings(spark, sf):
    cells, _, _ = rate_cells(measurements(spark, sf))
    return long_cells(cells, PROPS, ROW, ("index", "rating")).filter("index IS NOT NULL")


@query("real_boundaries", f"""WITH {S.RATED0}, tops AS (
 SELECT {S.G}, property, any_value(maximize) AS maximize, any_value(bounds) AS bounds,
  arg_max(value, row(index, coalesce(value, CAST('-inf' AS DOUBLE)))) AS ref FROM rated0 WHERE index IS NOT NULL GROUP BY {S.G}, property),
edges AS (SELECT *, list_concat(list_concat([CAST(100000 AS DOUBLE)], bounds), [CAST(-100 AS DOUBLE)]) AS e FROM tops)
SELECT {S.G}, property, CAST(i AS INTEGER) AS band, round({S.back_case('e[i + 1]')} + CAST(1e-9 AS DOUBLE), 6) AS start, round({S.back_case('e[i + 2]')} + CAST(1e-9 AS DOUBLE), 6) AS stop
FROM edges, range(5) AS t(i)""")
def real_valued_boundaries(spark, sf):
    cells, bounds, _ = rate_cells(measurements(spark, sf))
    return real_boundaries(cells, bounds, PROPS).select(*GROUP_KEYS, "property", "band", r6("start").alias("start"), r6("stop").alias("stop"))


@query("share_property", f"WITH {S.RATED} SELECT {S.G}, model, property, value, index, rating FROM rated WHERE index IS NOT NULL")
def shared_cells(spark, sf):
    cells, _, _ = rate_cells(measurements(spark, sf))
    return long_cells(share_independent(cells, PROPS), PROPS, ROW, ("value", "index", "rating")).filter("index IS NOT NULL")


def shared_table(spark, sf):
    """Rated cells after sharing, as a wide table."""
    cells, bounds, _ = rate_cells(measurements(spark, sf))
    return share_independent(cells, PROPS), bounds


@query("compound_index", f"WITH {S.SCORED} SELECT {S.G}, model, compound_index, quality_index, resource_index FROM scored")
def compound_scores(spark, sf):
    cells, _ = shared_table(spark, sf)
    return C.add_scores(cells, PROPS).select(*ROW, "compound_index", "quality_index", "resource_index")


@query("compound_rating", f"WITH {S.SCORE_RATED} SELECT {S.G}, model, compound_rating, quality_rating, resource_rating FROM score_rated")
def compound_ratings(spark, sf):
    return rate(measurements(spark, sf)).database.select(*ROW, "compound_rating", "quality_rating", "resource_rating")


_score_bounds = " UNION ALL ".join(
    f"SELECT '{s}_index' AS property, {S.quantiles(f'{s}_index')} AS bounds FROM scored" for s in C.SCORES
)


@query("compound_bounds", f"WITH {S.SCORED}, sb AS ({_score_bounds}) SELECT property, {_b4} FROM sb")
def compound_boundaries(spark, sf):
    cells, _ = shared_table(spark, sf)
    return _split_bounds(C.score_boundaries(materialize(C.add_scores(cells, PROPS))))


def _combined(spark, sf, mode):
    cells, _ = shared_table(spark, sf)
    items = [(idx(p.key), p.weight) for p in PROPS]
    return cells.selectExpr(*ROW, f"{settle(C.combine(items, mode))} AS score")


@query("compound_best", f"WITH {S.RATED} SELECT {S.G}, model, max(index) AS score FROM rated GROUP BY {S.G}, model")
def combine_best(spark, sf):
    return _combined(spark, sf, "best")


@query("compound_worst", f"WITH {S.RATED} SELECT {S.G}, model, min(index) AS score FROM rated GROUP BY {S.G}, model")
def combine_worst(spark, sf):
    return _combined(spark, sf, "worst")


@query("compound_mean", f"""WITH {S.RATED} SELECT {S.G}, model, round(sum(weight * index) / sum(CASE WHEN index IS NOT NULL THEN weight END) + CAST(1e-12 AS DOUBLE), 9) AS score
 FROM rated GROUP BY {S.G}, model""")
def combine_mean(spark, sf):
    return _combined(spark, sf, "pessimistic mean")


@query("compound_median", f"""WITH {S.RATED}, o AS (
 SELECT *, round(sum(weight) OVER (PARTITION BY {S.G}, model ORDER BY index DESC, pos DESC ROWS UNBOUNDED PRECEDING)
   / sum(weight) OVER (PARTITION BY {S.G}, model), 12) AS c,
  row_number() OVER (PARTITION BY {S.G}, model ORDER BY index DESC, pos DESC) AS rn
 FROM rated WHERE index IS NOT NULL), n AS (
 SELECT *, lead(c) OVER (PARTITION BY {S.G}, model ORDER BY rn) AS nc, lead(index) OVER (PARTITION BY {S.G}, model ORDER BY rn) AS ni FROM o)
SELECT {S.G}, model, round(arg_min(CASE WHEN c = 0.5 THEN (index + ni) / 2 ELSE index END, rn) + CAST(1e-12 AS DOUBLE), 9) AS score
FROM n WHERE c >= 0.5 OR nc > 0.5 GROUP BY {S.G}, model""")
def combine_median(spark, sf):
    return _combined(spark, sf, "optimistic median")


_MEDIANS = f"""med AS (SELECT *, median(value) OVER (PARTITION BY {S.G}, property) AS m FROM cells),
 scored_models AS (SELECT {S.G}, model, round(sum(coalesce(weight * ({S.index_case('value', 'm').replace('NOT maximize AND m < 0', 'false')}), 0)) + CAST(1e-12 AS DOUBLE), 9) AS score
 FROM med GROUP BY {S.G}, model),
 refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S.G} ORDER BY score, model) AS rn,
   count(*) OVER (PARTITION BY {S.G}) AS n FROM scored_models) WHERE rn = n // 2 + 1)"""


@query("optimal_reference", f"WITH {S.MEAS}, {S.cells()}, {_MEDIANS} SELECT {S.G}, model AS reference, score FROM refs")
def optimal_reference(spark, sf):
    return optimal_references(materialize(measurements(spark, sf)), PROPS).select(*GROUP_KEYS, "reference", "score")


_CENTERED = f"""{S.MEAS}, {S.cells()}, {_MEDIANS},
 first_ref AS (SELECT dataset, arg_min(model, concat(task, environment)) AS first_model FROM refs GROUP BY dataset),
 group_ref AS (SELECT r.dataset, r.task, r.environment, CASE WHEN EXISTS (SELECT 1 FROM meas m WHERE m.dataset = r.dataset AND m.task = r.task
   AND m.environment = r.environment AND m.model = f.first_model) THEN f.first_model ELSE r.model END AS reference
  FROM refs r JOIN first_ref f ON r.dataset = f.dataset),
 cen AS (SELECT c.*, max(CASE WHEN c.model = g.reference THEN c.value END) OVER (PARTITION BY c.dataset, c.task, c.environment, c.property) AS ref, g.reference
  FROM cells c JOIN group_ref g ON c.dataset = g.dataset AND c.task = g.task AND c.environment = g.environment)"""


@query("index_centered", f"""WITH {_CENTERED} SELECT {S.G}, model, property, reference, round({S.index_case()} + CAST(1e-12 AS DOUBLE), 9) AS index
 FROM cen WHERE group_count > 0""")
def centered_indices(spark, sf):
    meas = materialize(measurements(spark, sf))
    indexed, references = index_centered(meas, PROPS)
    present = index_best(meas, PROPS).select(*ROW, *[F.col(idx(p)).isNotNull().alias(f"{p}__has") for p in PROPERTY_KEYS])
    cells = F.array(*[
        F.struct(F.lit(p).alias("property"), F.col(idx(p)).alias("index"), F.col(f"{p}__has").alias("has"))
        for p in PROPERTY_KEYS
    ])
    return (
        indexed.join(present, ROW).join(references, list(GROUP_KEYS))
        .select(*ROW, "reference", F.inline(cells)).filter("has").drop("has")
    )


@query("rerate_fixed_bounds", f"""WITH {S.INDEXED}, rated0 AS (SELECT *,
  {S.band_case('index', "(CASE WHEN property = 'accuracy' THEN [CAST(0.99 AS DOUBLE), CAST(0.98 AS DOUBLE), CAST(0.97 AS DOUBLE), CAST(0.96 AS DOUBLE)] ELSE [CAST(0.9 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.6 AS DOUBLE)] END)")} AS rating FROM indexed),
 {S.shared()} SELECT {S.G}, model, property, rating FROM rated WHERE index IS NOT NULL""")
def rerated(spark, sf):
    """Rate, then rate the rated cells again with hand-edited boundaries."""
    first, _, _ = rate_cells(measurements(spark, sf))
    cells, _, _ = rate_cells(first, boundaries={"accuracy": [0.99, 0.98, 0.97, 0.96]})
    return long_cells(share_independent(cells, PROPS), PROPS, ROW, ("index", "rating")).filter("index IS NOT NULL").drop("index")


@query("update_weights", f"""WITH {S.RATED} SELECT {S.G}, model,
 round(coalesce(sum(w * index) / nullif(sum(CASE WHEN index IS NOT NULL THEN w END), 0), 0) + CAST(1e-12 AS DOUBLE), 9) AS compound_index
 FROM (SELECT *, CASE WHEN property = 'accuracy' THEN CAST(0.5 AS DOUBLE) WHEN property = 'power_draw' THEN CAST(0.25 AS DOUBLE)
   WHEN property = 'fsize' THEN CAST(0 AS DOUBLE) ELSE weight END AS w FROM rated) GROUP BY {S.G}, model""")
def changed_weights(spark, sf):
    cells, _ = shared_table(spark, sf)
    changed, _ = with_weights(PROPS, {"accuracy": 0.5, "power_draw": 0.25, "fsize": 0.0})
    return C.add_scores(cells, changed).select(*ROW, "compound_index")


def _wide(part):
    columns = ", ".join(f"max(CASE WHEN property = '{p}' THEN {part} END) AS {p}" for p in PROPERTY_KEYS)
    return f"WITH {S.RATED} SELECT {S.G}, model, {columns} FROM rated GROUP BY {S.G}, model"


@query("project_index", _wide("index"))
def project_index(spark, sf):
    cells, _ = shared_table(spark, sf)
    from gaugewright.operators.cells import as_cells, project
    return project(as_cells(cells, PROPS), PROPERTY_KEYS, "index").select(*ROW, *PROPERTY_KEYS)


@query("project_value", _wide("value"))
def project_value(spark, sf):
    cells, _ = shared_table(spark, sf)
    from gaugewright.operators.cells import as_cells, project
    projected = project(as_cells(cells, PROPS), PROPERTY_KEYS, "value")
    return projected.select(*ROW, *PROPERTY_KEYS)


@query("rating_hist", f"""WITH {S.SCORE_RATED}, bins AS (SELECT environment, CAST(i AS INTEGER) AS rating FROM (SELECT DISTINCT environment FROM score_rated), range(6) AS t(i))
SELECT b.environment, CASE b.rating WHEN 5 THEN 'N.A.' ELSE substr('ABCDE', b.rating + 1, 1) END AS rating, count(s.model) AS n
FROM bins b LEFT JOIN score_rated s ON b.environment = s.environment AND b.rating = coalesce(s.compound_rating, 5) GROUP BY ALL""")
def rating_histogram(spark, sf):
    rated = rate(measurements(spark, sf)).database
    counts = rated.groupBy("environment").agg(*[
        F.count_if(F.coalesce("compound_rating", F.lit(5)) == r).alias(str(r)) for r in range(6)
    ])
    names = F.array(*[F.struct(F.lit(n).alias("rating"), F.col(str(r)).alias("n")) for r, n in enumerate([*"ABCDE", "N.A."])])
    return counts.select("environment", F.inline(names))


@query("rate_summary", f"""WITH {S.SCORE_RATED} SELECT environment, model, round(avg(compound_index) + CAST(1e-9 AS DOUBLE), 6) AS compound_index,
 round(avg(compound_rating) + CAST(1e-9 AS DOUBLE), 6) AS compound_rating, round(avg(quality_index) + CAST(1e-9 AS DOUBLE), 6) AS quality_index, count(*) AS n FROM score_rated GROUP BY environment, model""")
def rate_summary(spark, sf):
    """Flagship: the whole rating, summed up per model and environment."""
    return rate(measurements(spark, sf)).database.groupBy("environment", "model").agg(
        r6(F.avg("compound_index")).alias("compound_index"),
        r6(F.avg("compound_rating")).alias("compound_rating"),
        r6(F.avg("quality_index")).alias("quality_index"), F.count("*").alias("n"),
    )
