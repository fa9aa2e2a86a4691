"""Queries: linear models from sums, classifiers, search, components, meta-learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.analysis import _FEATS, rated, tabular
from gaugewright.catalog.base import ORACLES, QUERIES, query, r6
from gaugewright.meta import DEFAULT_PROPERTIES as PROPS
from gaugewright.operators import classify as Y
from gaugewright.operators.compare import reference_values
from gaugewright.operators.gram import fit_linear, gram_sums
from gaugewright.operators.metafeatures import STATISTICAL, statistical
from gaugewright.operators.pca import pca_metafeatures, project
from gaugewright.operators.pooling import pair_pooling
from gaugewright.operators.scores import error_summary
from gaugewright.operators.search import draw_settings, min_rank
from gaugewright.plans import metalearn as ML
from gaugewright.plans.recommend import compound_predictions, recommend
from gaugewright.session import materialize
from gaugewright.sources.files import combine_metafeatures
from gaugewright.sources.views import runs, table

_GC = ("accuracy", "f1", "fsize", "parameters", "running_time")
_gram_sql = " UNION ALL ".join(
    f"SELECT model, task, {i} AS i, {j} AS j, round(sum({a} * {b}) + CAST(1e-9 AS DOUBLE), 6) AS s FROM v GROUP BY model, task"
    for i, a in enumerate(("one", *_GC)) for j, b in enumerate(("one", *_GC)) if i <= j
)


@query("gram_sums", f"WITH {S.RUNS}, v AS (SELECT *, CAST(1 AS DOUBLE) AS one FROM runs) {_gram_sql}")
def grams(spark, sf):
    vector = F.array(F.lit(1.0), *[F.col(c) for c in _GC])
    return gram_sums(runs(spark, sf).select("model", "task", vector.alias("v")), ["model", "task"], "v").withColumn("s", r6("s"))


_LIN = {"Linear Regression": "cxy / vx", "Ridge A1": "n * cxy / (n * vx + vx)", "Ridge A0.1": "n * cxy / (n * vx + 0.1::DOUBLE * vx)",
        "Lasso A0.01": "sign(cxy) * greatest(abs(cxy) / sqrt(vx) - 0.01::DOUBLE, 0) / sqrt(vx)",
        "ElasticNet A0.1": "sign(cxy) * greatest(abs(cxy) / sqrt(vx) - 0.05::DOUBLE, 0) / 1.05::DOUBLE / sqrt(vx)"}


@query("linear_fit", f"WITH {S.RUNS}, s AS (SELECT model, count(*) AS n, avg(train_running_time) AS mx, avg(train_power_draw) AS my, var_pop(train_running_time) AS vx, covar_pop(train_power_draw, train_running_time) AS cxy FROM runs GROUP BY model), f AS ("
       + " UNION ALL ".join(f"SELECT model, '{r}' AS regr, mx, my, {e} AS slope FROM s" for r, e in _LIN.items())
       + ") SELECT model, regr, round(slope + CAST(1e-9 AS DOUBLE), 6) AS slope, round(my - slope * mx, 5) AS intercept FROM f")
def linear_fit(spark, sf):
    found = fit_linear(runs(spark, sf), ["model"], ["train_running_time"], "train_power_draw", list(_LIN))
    return found.select("model", "regr", r6(F.col("coefficients")[0]).alias("slope"), F.round("intercept", 5).alias("intercept"))


# ---------------------------------------------------------------- classifiers

_LAB = "CAST(least(floor((l_extendedprice / 1000 + l_tax * 500) / 40), 2) AS INTEGER)"
_NB = ("q", "p", "d", "t")
_nb_cols = "l_quantity AS q, l_extendedprice / 1000 AS p, l_discount AS d, l_tax AS t"


def _nb_score(a):
    return (f"ln(CAST(c.n AS DOUBLE) / c.total) - 0.5 * (" + " + ".join(f"ln(2 * pi() * (c.{f}_v + c.eps)) + (x.{f} - c.{f}_m) * (x.{f} - c.{f}_m) / (c.{f}_v + c.eps)" for f in _NB) + ")")


@query("gaussian_nb", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LAB} AS label, {_nb_cols} FROM lineitem),
 e AS (SELECT greatest({', '.join(f'var_pop({f})' for f in _NB)}) * 1e-9::DOUBLE AS eps, count(*) AS total FROM x),
 c AS (SELECT label, count(*) AS n, {', '.join(f'avg({f}) AS {f}_m, var_pop({f}) AS {f}_v' for f in _NB)}, any_value(eps) AS eps, any_value(total) AS total FROM x, e GROUP BY label),
 s AS (SELECT x.*, c.label AS cl, round({_nb_score('x')}, 9) AS score FROM x, c),
 b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, p, any_value(label) AS label, arg_max(cl, row(score, -cl)) AS pred FROM s GROUP BY ALL)
SELECT label, pred, count(*) AS n FROM b GROUP BY ALL""")
def naive_bayes(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{_LAB} AS label", *_nb_cols.split(", "))
    model = Y.gaussian_nb(rows, list(_NB), "label")
    return Y.predict_gaussian(rows, list(_NB), model).groupBy("label", "pred").agg(F.count("*").alias("n"))


@query("ridge_classify", f"""WITH x AS (SELECT {_LAB} AS label, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem),
 y AS (SELECT k.cl, x.q, x.p, CASE WHEN x.label = k.cl THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM x, (VALUES (0), (1), (2)) AS k(cl)),
 s AS (SELECT cl, count(*) AS n, avg(q) AS mq, avg(p) AS mp, avg(y) AS my, var_pop(q) * count(*) + 1 AS a, covar_pop(q, p) * count(*) AS b, var_pop(p) * count(*) + 1 AS d,
  covar_pop(q, y) * count(*) AS r1, covar_pop(p, y) * count(*) AS r2 FROM y GROUP BY cl),
 w AS (SELECT cl, my, mq, mp, (d * r1 - b * r2) / (a * d - b * b) AS wq, (a * r2 - b * r1) / (a * d - b * b) AS wp FROM s),
 m AS (SELECT max(CASE WHEN cl = 0 THEN my - wq * mq - wp * mp END) AS b0, max(CASE WHEN cl = 0 THEN wq END) AS q0, max(CASE WHEN cl = 0 THEN wp END) AS p0,
  max(CASE WHEN cl = 1 THEN my - wq * mq - wp * mp END) AS b1, max(CASE WHEN cl = 1 THEN wq END) AS q1, max(CASE WHEN cl = 1 THEN wp END) AS p1,
  max(CASE WHEN cl = 2 THEN my - wq * mq - wp * mp END) AS b2, max(CASE WHEN cl = 2 THEN wq END) AS q2, max(CASE WHEN cl = 2 THEN wp END) AS p2 FROM w),
 t AS (SELECT label, b0 + q0 * q + p0 * p AS s0, b1 + q1 * q + p1 * p AS s1, b2 + q2 * q + p2 * p AS s2 FROM x, m)
SELECT label, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred, count(*) AS n FROM t GROUP BY ALL""")
def ridge_classes(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{_LAB} AS label", "l_quantity AS q", "l_extendedprice / 1000 AS p")
    model = Y.ridge_classifier(rows, ["q", "p"], "label")
    return Y.predict_linear(rows, ["q", "p"], model).groupBy("label", "pred").agg(F.count("*").alias("n"))


# The grids of the searched methods.
GRIDS = {"GNB": {"smoothing": [1e-5, 1e-6, 1e-7, 1e-8, 1e-9, 1e-10, 1e-11, 1e-12]}, "RR": {"alpha": [0.05, 0.2, 1.0, 5.0, 20.0, 1e4, 1e6, 1e8]}}
N_ITER = 6  # settings drawn per method
_DRAWN = {m: draw_settings(g, N_ITER) for m, g in GRIDS.items()}
_FOLD = "CAST((l_orderkey * 7 + l_linenumber) % 5 AS INT)"


def _values(method, name):
    return ", ".join(f"({i}, {S.dbl(x[name])})" for i, x in enumerate(_DRAWN[method]))


_search_nb = " + ".join(f"ln(2 * pi() * (c.{f}_v + g.s * e.v)) + (x.{f} - c.{f}_m) * (x.{f} - c.{f}_m) / (c.{f}_v + g.s * e.v)" for f in _NB)


@query("random_search", f"""WITH x AS (SELECT row_number() OVER () AS id, {_LAB} AS label, {_FOLD} AS fold, {_nb_cols} FROM lineitem), f AS (SELECT DISTINCT fold FROM x),
 c AS (SELECT f.fold, x.label, count(*) AS n, {', '.join(f'avg({k}) AS {k}_m, var_pop({k}) AS {k}_v' for k in _NB)} FROM x JOIN f ON x.fold <> f.fold GROUP BY f.fold, x.label),
 e AS (SELECT f.fold, greatest({', '.join(f'var_pop({k})' for k in _NB)}) AS v, count(*) AS total FROM x JOIN f ON x.fold <> f.fold GROUP BY f.fold),
 g(pos, s) AS (VALUES {_values('GNB', 'smoothing')}),
 nb AS (SELECT 'GNB' AS method, x.id, x.fold, g.pos, x.label, arg_max(c.label, row(round(ln(c.n / e.total) - 0.5 * ({_search_nb}), 9), -c.label)) AS pred
  FROM x JOIN c ON x.fold = c.fold JOIN e ON x.fold = e.fold, g GROUP BY x.id, x.fold, g.pos, x.label),
 h(pos, a) AS (VALUES {_values('RR', 'alpha')}),
 y AS (SELECT f.fold, k.cl, x.q, x.p, CASE WHEN x.label = k.cl THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM x JOIN f ON x.fold <> f.fold, (SELECT DISTINCT label AS cl FROM x) AS k),
 m AS (SELECT fold, cl, count(*) AS n, avg(q) AS mq, avg(p) AS mp, avg(y) AS my, var_pop(q) * count(*) AS vq, covar_pop(q, p) * count(*) AS b, var_pop(p) * count(*) AS vp,
  covar_pop(q, y) * count(*) AS r1, covar_pop(p, y) * count(*) AS r2 FROM y GROUP BY fold, cl),
 w AS (SELECT fold, cl, h.pos, mq, mp, my, ((vp + a) * r1 - b * r2) / ((vq + a) * (vp + a) - b * b) AS wq, ((vq + a) * r2 - b * r1) / ((vq + a) * (vp + a) - b * b) AS wp FROM m, h),
 rr AS (SELECT 'RR' AS method, x.id, x.fold, w.pos, x.label, arg_max(w.cl, row(round(my + wq * (x.q - mq) + wp * (x.p - mp), 9), -w.cl)) AS pred FROM x JOIN w ON x.fold = w.fold GROUP BY x.id, x.fold, w.pos, x.label),
 per AS (SELECT method, pos, fold, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM (SELECT * FROM nb UNION ALL SELECT * FROM rr) GROUP BY ALL),
 s AS (SELECT method, CAST(pos AS INTEGER) AS pos, round(avg(score) + CAST(1e-9 AS DOUBLE), 6) AS mean_test_score, round(stddev_pop(score) + CAST(1e-9 AS DOUBLE), 6) AS std_test_score FROM per GROUP BY ALL)
SELECT 'lineitem' AS dataset, method, pos, mean_test_score, std_test_score, CAST(rank() OVER (PARTITION BY method ORDER BY mean_test_score DESC) AS INTEGER) AS rank_test_score FROM s""")
def random_search(spark, sf):
    """Cross-validated score, deviation and rank of the drawn settings of two classifiers."""
    rows = table(spark, sf, "lineitem").selectExpr(f"{_LAB} AS label", *_nb_cols.split(", "), f"{_FOLD} AS fold")
    smoothings, alphas = [x["smoothing"] for x in _DRAWN["GNB"]], [x["alpha"] for x in _DRAWN["RR"]]
    found = Y.search_gaussian(rows, list(_NB), "label", "fold", smoothings).withColumn("method", F.lit("GNB")).unionByName(
        Y.search_ridge(rows, ["q", "p"], "label", "fold", alphas).withColumn("method", F.lit("RR"))
    )
    settled = found.withColumns({c: r6(c) for c in ("mean_test_score", "std_test_score")})
    return min_rank(settled.withColumn("dataset", F.lit("lineitem")))


# ---------------------------------------------------------------- components and pooled pairs


def _jacobi(name, source, key, columns, components, sweeps):
    """SQL for the leading components of standardized columns: rotations in turn until the correlations are diagonal.

    Gives a table of that name with (key, comp, shift, w), weights on the raw columns.
    """
    p = len(columns)
    flat = lambda c: f"stddev_pop({c}) <= 1e-9 * greatest(abs(avg({c})), 1)"
    sds = ", ".join(f"CASE WHEN {flat(c)} THEN 1.0::DOUBLE ELSE stddev_pop({c}) END" for c in columns)
    entry = lambda x, y: f"CASE WHEN {flat(x)} OR {flat(y)} THEN 0.0::DOUBLE ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    matrix = ", ".join(entry(*sorted((x, y), key=columns.index)) for x in columns for y in columns)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    at = lambda m, x, y: f"{m}[({x}) * {p} + ({y}) + 1]"
    cols = lambda m: f"list_transform(range({p * p}), lambda e : CASE e % {p} WHEN i THEN c * {at(m, f'e // {p}', 'i')} - s * {at(m, f'e // {p}', 'j')} WHEN j THEN s * {at(m, f'e // {p}', 'i')} + c * {at(m, f'e // {p}', 'j')} ELSE {m}[e + 1] END)"
    rows = f"list_transform(range({p * p}), lambda e : CASE e // {p} WHEN i THEN c * {at('b', 'i', f'e % {p}')} - s * {at('b', 'j', f'e % {p}')} WHEN j THEN s * {at('b', 'i', f'e % {p}')} + c * {at('b', 'j', f'e % {p}')} ELSE b[e + 1] END)"
    eye = ", ".join("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for i in range(p) for j in range(p))
    by = f"{key}, " if key else ""
    return f"""{name}_m AS MATERIALIZED (SELECT {by}[{", ".join(f"avg({c})" for c in columns)}] AS mean, [{sds}] AS sd, [{matrix}] AS a FROM {source}{f" GROUP BY {key}" if key else ""}),
 {name}_p(i, j, turn) AS (VALUES {", ".join(f"({i}, {j}, {t})" for t, (i, j) in enumerate(pairs))}),
 {name}_r({by}turn, a, v) AS (
  SELECT {by}0, a, [{eye}] FROM {name}_m
  UNION ALL
  SELECT {by}turn, {rows}, v FROM (
   SELECT {by}turn + 1 AS turn, i, j, c, s, {cols("a")} AS b, {cols("v")} AS v FROM (
    SELECT *, t / sqrt(t * t + 1) AS s, 1 / sqrt(t * t + 1) AS c FROM (
     SELECT {", ".join(f"r.{k}" for k in ([key] if key else []) + ["turn", "a", "v"])}, i, j, CASE WHEN abs({at("a", "i", "j")}) < 1e-300 THEN 0.0::DOUBLE ELSE
       CASE WHEN {at("a", "j", "j")} >= {at("a", "i", "i")} THEN 1 ELSE -1 END / (abs(({at("a", "j", "j")} - {at("a", "i", "i")}) / (2 * {at("a", "i", "j")})) + sqrt(power(({at("a", "j", "j")} - {at("a", "i", "i")}) / (2 * {at("a", "i", "j")}), 2) + 1)) * sign({at("a", "i", "j")}) END AS t
     FROM {name}_r r JOIN {name}_p p ON p.turn = r.turn % {len(pairs)} WHERE r.turn < {sweeps * len(pairs)}
    )
   )
  )
 ),
 {name}_e AS (SELECT {by}k, row_number() OVER ({f"PARTITION BY {key} " if key else ""}ORDER BY a[k * {p + 1} + 1] DESC) - 1 AS comp, list_transform(range({p}), lambda e : v[e * {p} + k + 1]) AS u FROM {name}_r, range({p}) t(k) WHERE turn = {sweeps * len(pairs)}),
 {name}_s AS (SELECT {by}comp, list_transform(u, lambda e : e * sign(list_first(list_filter(u, lambda f : round(abs(f), 9) = list_max(list_transform(u, lambda g : round(abs(g), 9))))))) AS u FROM {name}_e WHERE comp < {components}),
 {name} AS MATERIALIZED (SELECT {by}comp, w, -list_dot_product(mean, w) AS shift FROM (SELECT {by}comp, mean, list_transform(range({p}), lambda e : u[e + 1] / sd[e + 1]) AS w FROM {name}_s JOIN {name}_m {f"USING ({key})" if key else "ON true"}))"""


_PCA = (*_FEATS, "code")
_PCA_NAMES = {"min": "min(score)", "max": "max(score)", "mean": "avg(score)", "std": "stddev_pop(score)", "median": "quantile_cont(score, 0.5)"}
_TAB = f"t AS MATERIALIZED (SELECT p_brand AS dataset, l_returnflag AS label, {', '.join(f'{e} AS {f}' for f, e in _FEATS.items())}, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("mf_pca", f"""WITH RECURSIVE {_TAB}, {_jacobi("pc", "t", "dataset", _PCA, 3, 8)},
 s AS (SELECT t.dataset, comp, shift + list_dot_product(w, [{", ".join(_PCA)}]) AS score FROM t JOIN pc USING (dataset)),
 a AS (SELECT dataset, comp, {", ".join(f"round({e} + CAST(1e-9 AS DOUBLE), 6) AS {n}" for n, e in _PCA_NAMES.items())} FROM s GROUP BY dataset, comp)
SELECT dataset, {", ".join(f'max(CASE WHEN comp = {c} THEN a.{n} END) AS "{c}_{n}"' for c in range(3) for n in _PCA_NAMES)} FROM a GROUP BY dataset""")
def mf_pca(spark, sf):
    data = tabular(spark, sf).withColumn("code", F.expr("CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"))
    found = pca_metafeatures(data, list(_FEATS), "code")
    return found.select("dataset", *[r6(F.col(f"`{c}`")).alias(c) for c in found.columns if c != "dataset"])


_MAP_SQL = ORACLES["mf_statistical"]


@query("dataset_map", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT dataset, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in STATISTICAL)} FROM ({_MAP_SQL})),
 {_jacobi("pc", "f", "", STATISTICAL, 2, 10)}
SELECT f.dataset, {", ".join(f"round(max(CASE WHEN comp = {c} THEN shift + list_dot_product(w, [{', '.join(STATISTICAL)}]) END) + CAST(1e-9 AS DOUBLE), 5) AS {n}" for c, n in enumerate("xy"))} FROM f, pc GROUP BY f.dataset""")
def dataset_map(spark, sf):
    """Two components of the (rounded) statistical features of the data sets."""
    features = materialize(QUERIES["mf_statistical"](spark, sf).fillna(0.0).fillna(0))
    scores = project(features, [], list(STATISTICAL), 2, ["dataset"])
    return scores.groupBy("dataset").agg(*[F.round(F.max(F.when(F.col("component") == i, F.col("score"))) + 1e-9, 5).alias(n) for i, n in enumerate("xy")])


_POOL = tuple(_FEATS)
_DRAWS = 160
_MARK = "CAST(concat('0x', substr(md5(id), 1, 13)) AS BIGINT) % 2147483647"
_PLACE = "(mark * ((d.draw * 104729 + 7919) * 15485863 % 2147483647 + 1) + d.draw * 32452843) % 2147483647"


@query("pair_pooling", f"""WITH t AS (SELECT *, {_MARK} AS mark FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, p_brand AS dataset, l_returnflag AS label,
  {', '.join(f'{e} AS {f}' for f, e in _FEATS.items())} FROM lineitem JOIN part ON l_partkey = p_partkey)),
 s AS (SELECT * FROM (SELECT t.*, d.draw, row_number() OVER (PARTITION BY dataset, d.draw ORDER BY {_PLACE}, id) AS rn FROM t, range({_DRAWS}) AS d(draw)) WHERE rn <= 256),
 cl AS (SELECT * FROM (SELECT DISTINCT dataset, label FROM t), range({_DRAWS}) AS d(draw)),
 r AS (SELECT dataset, draw, count(*) AS n, {', '.join(f'avg({f}) AS {f}' for f in _POOL)} FROM s GROUP BY dataset, draw),
 k AS (SELECT dataset, draw, label, count(*) AS c, {', '.join(f'sum({f}) AS {f}' for f in _POOL)} FROM s GROUP BY dataset, draw, label),
 p AS (SELECT cl.dataset, cl.draw, ({' + '.join(f'r.{f}' for f in _POOL)}) / {len(_POOL)} AS x, coalesce(k.c, 0) / r.n AS y, coalesce({' + '.join(f'k.{f}' for f in _POOL)}, 0) / r.n / {len(_POOL)} AS xy
  FROM cl JOIN r USING (dataset, draw) LEFT JOIN k USING (dataset, draw, label)),
 m AS (SELECT dataset, draw, avg(x) AS x, avg(y) AS y, avg(xy) AS xy FROM p GROUP BY dataset, draw)
SELECT dataset, round(avg(x) + CAST(1e-9 AS DOUBLE), 6) AS mean_x, round(avg(y) + CAST(1e-9 AS DOUBLE), 6) AS mean_y, round(avg(xy) + CAST(1e-9 AS DOUBLE), 6) AS mean_xy FROM m GROUP BY dataset""")
def pooled_pairs(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), F.col("p_brand").alias("dataset"),
        F.col("l_returnflag").alias("label"), *[F.expr(_FEATS[f]).alias(f) for f in _POOL],
    )
    found = pair_pooling(rows, "id", list(_POOL), "label", draws=_DRAWS)
    return found.select("dataset", *[r6(c).alias(c) for c in ("mean_x", "mean_y", "mean_xy")])


# ---------------------------------------------------------------- meta-learning


ENVIRONMENTS = ("Arch F - Engine 1.0", "Arch O - Engine 1.0")


def learned(spark, sf):
    """Predictions and chosen regressors from every feature set: statistics, components, and both."""
    cells = rated(spark, sf)
    data = tabular(spark, sf).withColumn("code", F.expr("CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"))
    statistics = materialize(statistical(data, list(_FEATS), "label").fillna(0.0))
    components = materialize(pca_metafeatures(data, list(_FEATS), "code").fillna(0.0))
    components = components.withColumnsRenamed({c: f"pca_{c}" for c in components.columns if c != "dataset"})
    sets = {"statistical": statistics, "pca": components, "combined": combine_metafeatures(statistics, components)}
    design = ML.design_sets(cells, reference_values(cells, PROPS), sets, PROPS, ENVIRONMENTS)
    predictions, chosen = ML.meta_learn(materialize(design), PROPS)
    return cells, materialize(ML.split_sets(predictions)), ML.split_sets(chosen)


@query("meta_learn")
def meta_learn(spark, sf):
    return learned(spark, sf)[1]


@query("meta_learn_errors")
def meta_learn_errors(spark, sf):
    return error_summary(learned(spark, sf)[1], "test_err", ["feature_set", "scale", "property"])


@query("meta_learn_regressors")
def meta_learn_regressors(spark, sf):
    return learned(spark, sf)[2].groupBy("feature_set", "regr").agg(F.count("*").alias("n"))


@query("meta_learn_recommend")
def meta_learn_recommend(spark, sf):
    """Recommended algorithm per environment and data set by the compound score learned from both feature sets."""
    _, predictions, _ = learned(spark, sf)
    index = predictions.filter("scale = 'index' AND feature_set = 'combined'").withColumn("pred", F.col("test_pred"))
    return recommend(compound_predictions(index, PROPS), "compound_pred")
