"""Queries: classifiers fitted by this library's own passes, with SQL that repeats or re-derives each fit."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gaugewright.catalog.analysis import _clf_sql, _round_scores
from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.catalog.ingest import meas
from gaugewright.operators import classify as Y
from gaugewright.operators.descent import linear_sgd
from gaugewright.operators.forest import chosen_features, forest_scores, poisson_limits, random_forest
from gaugewright.operators.logistic import logistic, logistic_scores
from gaugewright.operators.perceptron import first_weights, perceptron, perceptron_scores
from gaugewright.operators.prep import train_test_split
from gaugewright.operators.scores import classification_scores, error_summary
from gaugewright.operators.search import average_rank, draw_settings
from gaugewright.operators.sums import classified
from gaugewright.operators.trees import DEPTH, cell_sums, fold_trees, walk
from gaugewright.operators.tuning import METHODS, search
from gaugewright.session import materialize, new_stage
from gaugewright.sources.views import table


def vectors(spark, sf):
    """The embedding table with its train and test part."""
    split = train_test_split(table(spark, sf, "embeddings"), "vec_id")
    return materialize(split.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), "is_test"))


def scored(rows, name, model, scores, size):
    """Scores of the test part, the method and the number of parameters."""
    found = classified(rows.filter("is_test"), "x", model.classes, scores, "int")
    return _round_scores(classification_scores(found, "label", "pred")).withColumns(
        {"method": F.lit(name), "n_parameters": F.lit(size).cast("long")}
    )


def metrics(name, size):
    """SQL for the same from a table `chosen` (truth, pred); the size is an SQL expression."""
    return f"SELECT s.*, '{name}' AS method, CAST(({size}) AS BIGINT) AS n_parameters FROM ({_clf_sql('chosen', 'truth', 'pred')}) s"


_E = """e AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda v : CAST(v AS DOUBLE)) AS x,
  row_number() OVER (ORDER BY substr(md5(concat(vec_id, '-42')), 1, 13)) <= ceil(count(*) OVER () * CAST(0.25 AS DOUBLE)) AS is_test FROM embeddings),
 cls AS MATERIALIZED (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT label FROM e WHERE NOT is_test)),
 tr AS MATERIALIZED (SELECT id, k AS y, list_prepend(1.0::DOUBLE, x) AS x FROM e JOIN cls USING (label) WHERE NOT is_test),
 dims AS MATERIALIZED (SELECT (SELECT count(*) FROM cls) AS n_classes, max(len(x)) AS p, count(*) AS n, 0.5::DOUBLE * sum(list_dot_product(x, x)) + 1 AS l FROM tr)"""

_BY_WEIGHTS = """chosen AS (SELECT truth, arg_max(label, row(s, -k)) AS pred FROM (
   SELECT e.id, e.label AS truth, cls.label, cls.k, list_dot_product(list_prepend(1.0::DOUBLE, e.x), f.w[cls.k * p + 1 : (cls.k + 1) * p]) AS s FROM e, cls, final f, dims WHERE e.is_test
 ) GROUP BY id, truth)"""

# ---------------------------------------------------------------- logistic regression

# The minimum is unique up to equal shifts of the intercepts, so SQL may go there by another way: accelerated steps.
_STEPS = 220


@query("classify_logistic", f"""WITH RECURSIVE {_E},
 it(i, w, v) AS (
  SELECT 0, list_transform(range(n_classes * p), lambda j : 0.0::DOUBLE), list_transform(range(n_classes * p), lambda j : 0.0::DOUBLE) FROM dims
  UNION ALL
  SELECT i + 1, list(nw ORDER BY k, j), list(nw + (sqrt(l) - 1) / (sqrt(l) + 1) * (nw - ow) ORDER BY k, j) FROM (
   SELECT i, k, j, any_value(l) AS l, any_value(w[k * p + j]) AS ow,
    any_value(v[k * p + j]) - (sum(r * x[j]) + CASE WHEN j > 1 THEN any_value(v[k * p + j]) ELSE 0 END) / any_value(l) AS nw FROM (
    SELECT i, w, v, x, k, p, l, unnest(range(1, p + 1)) AS j, u / sum(u) OVER (PARTITION BY id) - CASE WHEN k = y THEN 1 ELSE 0 END AS r FROM (
     SELECT i, w, v, id, y, x, k, p, l, exp(list_dot_product(x, v[k * p + 1 : (k + 1) * p])) AS u FROM it, dims, tr, (SELECT k FROM cls) c WHERE i < {_STEPS}
    )
   ) GROUP BY i, k, j
  ) GROUP BY i
 ),
 final AS (SELECT w FROM it WHERE i = {_STEPS}), {_BY_WEIGHTS}
{metrics("LR", "SELECT n_classes * p FROM dims")}""")
def classify_logistic(spark, sf):
    rows = vectors(spark, sf)
    model = logistic(rows.filter("NOT is_test"), "x", "label")
    return scored(rows, "LR", model, lambda x: logistic_scores(model, x), model.weights.size)


_LATE = "CASE WHEN l_quantity / 50 + l_tax * 4 + l_discount * ((l_orderkey * 7 + l_linenumber) % 13) > 1.2 THEN 1 ELSE 0 END"


def _newton(rounds):
    """Unrolled Newton steps on (1, a, b) with half the squared slopes as penalty, solved by determinants."""
    cols = ("1", "a", "b")
    g = ", ".join(f"sum((s - y) * {c}) AS g{i}" for i, c in enumerate(cols))
    h = ", ".join(f"sum(s * (1 - s) * {cols[i]} * {cols[j]}) + {1 if i == j and i else 0} AS h{i}{j}" for i in range(3) for j in range(i, 3))
    text = "w0 AS (SELECT 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2)"
    for r in range(rounds):
        text += f""",
 s{r} AS (SELECT {g}, {h}, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2 FROM (SELECT r.*, w.*, 1 / (1 + exp(-(x0 + x1 * a + x2 * b))) AS s FROM r, w{r} w)),
 t{r} AS (SELECT *, g1 + x1 AS d1, g2 + x2 AS d2, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{r}),
 w{r + 1} AS (SELECT x0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (d1 * h22 - h12 * d2) + h02 * (d1 * h12 - h11 * d2)) / det AS x0,
  x1 - (h00 * (d1 * h22 - h12 * d2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * d2 - d1 * h02)) / det AS x1,
  x2 - (h00 * (h11 * d2 - d1 * h12) - h01 * (h01 * d2 - d1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS x2 FROM t{r})"""
    return text


@query("logistic_weights", f"""WITH r AS MATERIALIZED (SELECT {_LATE} AS y, l_quantity / 50 AS a, l_tax * 10 AS b FROM lineitem), {_newton(9)}
SELECT round(x0 + CAST(1e-9 AS DOUBLE), 5) AS intercept, round(x1 + CAST(1e-9 AS DOUBLE), 5) AS a, round(x2 + CAST(1e-9 AS DOUBLE), 5) AS b, true AS converged FROM w9""")
def logistic_weights(spark, sf):
    rows = materialize(table(spark, sf, "lineitem").select(F.expr(_LATE).alias("y"), F.expr("array(l_quantity / 50, l_tax * 10)").alias("x")))
    model = logistic(rows, "x", "y")
    found = [(*[float(v) for v in model.weights[0]], model.converged)]
    out = spark.createDataFrame(found, "intercept double, a double, b double, converged boolean")
    return out.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("intercept", "a", "b")], "converged")


# ---------------------------------------------------------------- random forest

_TREES, _DEPTH, _BINS, _SEED = 40, 10, 32, 42
_limits = ", ".join(map(str, poisson_limits()))


def _levels(depth, trees, bins, seed):
    """Level by level: histograms of the nodes, their best cuts, the rows' next nodes."""
    text = f"""q AS (SELECT f, list_sort(list_distinct(quantile_cont(v, [{', '.join(f'{i / bins!r}::DOUBLE' for i in range(1, bins))}]))) AS q
   FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS f FROM e WHERE NOT is_test) GROUP BY f),
 codes AS MATERIALIZED (SELECT id, label, is_test, list(c ORDER BY f) AS c FROM (
   SELECT id, label, is_test, b.f, len(list_filter(q, lambda t : t < v)) AS c FROM (SELECT id, label, is_test, unnest(x) AS v, unnest(range(len(x))) AS f FROM e) b JOIN q USING (f)
  ) GROUP BY ALL),
 many AS (SELECT CAST(floor(sqrt(max(len(c)))) AS BIGINT) AS m, max(len(c)) AS p FROM codes),
 drawn AS MATERIALIZED (SELECT c.id, k.k AS y, t.tree, c.c, CASE WHEN is_test THEN 0 ELSE len(list_filter([{_limits}], lambda l : CAST(concat('0x', substr(md5(concat(c.id, '-', t.tree, '-{seed}')), 1, 13)) AS BIGINT) >= l)) END AS w
   FROM codes c LEFT JOIN cls k USING (label), range({trees}) t(tree)),
 a0 AS MATERIALIZED (SELECT id, tree, CAST(1 AS BIGINT) AS node FROM drawn)"""
    for d in range(depth):
        text += f""",
 n{d} AS (SELECT DISTINCT a.tree, a.node FROM a{d} a WHERE a.node >= {2 ** d}),
 u{d} AS (SELECT tree, node, f FROM (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node ORDER BY md5(concat(tree, '-', node, '-', f, '-{seed}')), f) AS nth, m FROM n{d}, many, LATERAL (SELECT unnest(range(p)) AS f) z) WHERE nth <= m),
 h{d} AS MATERIALIZED (SELECT a.tree, a.node, u.f, CAST(d.c[u.f + 1] AS BIGINT) AS b, d.y, sum(d.w)::DOUBLE AS s FROM a{d} a JOIN drawn d ON d.id = a.id AND d.tree = a.tree AND d.w > 0 JOIN u{d} u ON u.tree = a.tree AND u.node = a.node GROUP BY ALL),
 l{d} AS (SELECT h.tree, h.node, h.f, t.b, h.y, sum(CASE WHEN h.b <= t.b THEN h.s ELSE 0 END) AS l, sum(h.s) AS s FROM h{d} h, range({bins}) t(b) GROUP BY ALL),
 g{d} AS (SELECT tree, node, f, b, round((sum(l * l) / sum(l) + sum((s - l) * (s - l)) / sum(s - l) - sum(s * s) / sum(s)) / sum(s), 9) AS gain FROM l{d} GROUP BY ALL HAVING sum(l) > 0 AND sum(s - l) > 0),
 b{d} AS MATERIALIZED (SELECT tree, node, f, b FROM g{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, b) = 1),
 a{d + 1} AS MATERIALIZED (SELECT a.id, a.tree, CASE WHEN s.f IS NULL THEN a.node ELSE 2 * a.node + CASE WHEN d.c[s.f + 1] > s.b THEN 1 ELSE 0 END END AS node
   FROM a{d} a JOIN drawn d ON d.id = a.id AND d.tree = a.tree LEFT JOIN b{d} s ON s.tree = a.tree AND s.node = a.node)"""
    return text


@query("classify_forest", f"""WITH {_E}, {_levels(_DEPTH, _TREES, _BINS, _SEED)},
 leaf AS MATERIALIZED (SELECT a.tree, a.node, d.y, sum(d.w) / sum(sum(d.w)) OVER (PARTITION BY a.tree, a.node) AS share FROM a{_DEPTH} a JOIN drawn d ON d.id = a.id AND d.tree = a.tree WHERE d.w > 0 GROUP BY a.tree, a.node, d.y),
 votes AS (SELECT a.id, l.y, round(sum(l.share) / {_TREES}, 9) AS s FROM a{_DEPTH} a JOIN leaf l ON l.tree = a.tree AND l.node = a.node GROUP BY a.id, l.y),
 chosen AS (SELECT e.label AS truth, arg_max(cls.label, row(s, -cls.k)) AS pred FROM votes v JOIN e ON e.id = v.id AND e.is_test JOIN cls ON cls.k = v.y GROUP BY e.id, e.label)
{metrics("RF", "SELECT 2 * sum(2 * n - 1) FROM (SELECT tree, count(DISTINCT node) AS n FROM leaf GROUP BY tree)")}""")
def classify_forest(spark, sf):
    rows = vectors(spark, sf)
    model = random_forest(rows.filter("NOT is_test"), "x", "label", "vec_id", trees=_TREES, depth=_DEPTH, bins=_BINS, seed=_SEED)
    return scored(rows, "RF", model, lambda x: forest_scores(model, x), model.n_parameters())


# ---------------------------------------------------------------- stochastic gradient descent

_CHAIN, _PASSES, _ALPHA, _RATE = 100, 5, 1e-4, 0.5
_SLOPES = {"hinge": "CASE WHEN m < 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END", "log_loss": "-1 / (1 + exp(m))"}


def _descent(loss):
    """Each pass is a recursion along the chains, then a weighted mean."""
    text = f"""placed AS (SELECT *, CAST(concat('0x', substr(md5(concat(id, '-42')), 1, 13)) AS BIGINT) AS place FROM tr),
 chained AS MATERIALIZED (SELECT id, y, x, chain, row_number() OVER (PARTITION BY chain ORDER BY place, CAST(id AS VARCHAR)) AS pos, count(*) OVER (PARTITION BY chain) AS n
   FROM (SELECT placed.*, place % CAST(ceil(dims.n / {_CHAIN}) AS BIGINT) AS chain FROM placed, dims)),
 m0 AS MATERIALIZED (SELECT k, list_transform(range(p), lambda j : 0.0::DOUBLE) AS w FROM cls, dims)"""
    for i in range(_PASSES):
        text += f""",
 p{i}(chain, k, pos, w) AS (
  SELECT chain, k, 0, w FROM m{i}, (SELECT DISTINCT chain FROM chained)
  UNION ALL
  SELECT chain, k, pos + 1, list_transform(range(1, len(w) + 1), lambda j : CASE WHEN j = 1 THEN w[j] ELSE w[j] * (1 - eta * {_ALPHA!r}::DOUBLE) END - eta * pull * x[j]) FROM (
   SELECT chain, k, pos, w, x, eta, {_SLOPES[loss]} * target AS pull FROM (
    SELECT s.chain, s.k, s.pos, s.w, t.x, CASE WHEN t.y = s.k THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS target,
     CASE WHEN t.y = s.k THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * list_dot_product(s.w, t.x) AS m,
     {_RATE!r}::DOUBLE / (1 + {_ALPHA!r}::DOUBLE * {_RATE!r}::DOUBLE * (s.pos + {i} * t.n)) AS eta
    FROM p{i} s JOIN chained t ON t.chain = s.chain AND t.pos = s.pos + 1
   )
  )
 ),
 m{i + 1} AS MATERIALIZED (SELECT k, list(v ORDER BY j) AS w FROM (
   SELECT s.k, j, sum(s.w[j] * s.pos) / sum(s.pos) AS v FROM p{i} s JOIN (SELECT DISTINCT chain, n FROM chained) c ON c.chain = s.chain AND c.n = s.pos, LATERAL (SELECT unnest(range(1, len(s.w) + 1)) AS j) GROUP BY s.k, j) GROUP BY k)"""
    return text + f", final AS (SELECT flatten(list(w ORDER BY k)) AS w FROM m{_PASSES})"


def _sgd(spark, sf, loss):
    rows = vectors(spark, sf)
    model = linear_sgd(rows.filter("NOT is_test"), "x", "label", "vec_id", loss, _ALPHA, _RATE, _PASSES, chain_rows=_CHAIN)
    return scored(rows, "SGD", model, lambda x: Y.linear_scores(model.weights, x), model.weights.size)


def _sgd_sql(loss):
    return f"WITH RECURSIVE {_E}, {_descent(loss)}, {_BY_WEIGHTS} {metrics('SGD', 'SELECT n_classes * p FROM dims')}"


@query("classify_linear_svm", _sgd_sql("hinge"))
def classify_linear_svm(spark, sf):
    return _sgd(spark, sf, "hinge")


@query("classify_sgd_log", _sgd_sql("log_loss"))
def classify_sgd_log(spark, sf):
    return _sgd(spark, sf, "log_loss")


# ---------------------------------------------------------------- perceptron


@query("classify_perceptron")
def classify_perceptron(spark, sf):
    """Trained until no entry of the gradient exceeds the tolerance."""
    rows = vectors(spark, sf)
    model = perceptron(rows.filter("NOT is_test"), "x", "label", hidden=(50,), alpha=0.1, activation="tanh", tolerance=1e-3)
    found = scored(rows, "MLP", model, lambda x: perceptron_scores(model, x), model.weights.size)
    return found.withColumns({"rounds": F.lit(model.rounds), "converged": F.lit(model.converged)})


_START = [round(float(w), 6) for w in first_weights((2, 2, 2))]
_ROUNDS, _STEP, _MOMENTUM, _DECAY = 25, 0.8, 0.5, 0.01


def _perceptron_sql():
    """Forward and backward of a net with two inputs, two hidden units and two outputs, as sums per round."""
    # Places in w (from 1): hidden constants 1, 2; from a 3, 4; from b 5, 6; output constants 7, 8; from unit one 9, 10; from unit two 11, 12.
    g = ["d1", "d2", "d1 * a", "d2 * a", "d1 * b", "d2 * b", "e1", "e2", "e1 * h1", "e2 * h1", "e1 * h2", "e2 * h2"]
    free = {1, 2, 7, 8}
    sums = ", ".join(f"avg({x}) + {0 if i in free else 1} * {_DECAY!r}::DOUBLE / count(*) * any_value(w[{i}])" for i, x in enumerate(g, 1))
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT {_LATE} AS y, l_quantity / 50 AS a, l_tax * 10 AS b FROM lineitem),
 it(i, w, v) AS (
  SELECT 1, [{', '.join(f'{w!r}::DOUBLE' for w in _START)}], [{', '.join(['0.0::DOUBLE'] * 12)}]
  UNION ALL
  SELECT i + 1, list_transform(range(1, 13), lambda j : w[j] + {_MOMENTUM!r}::DOUBLE * v[j] - {_STEP!r}::DOUBLE * g[j]), list_transform(range(1, 13), lambda j : {_MOMENTUM!r}::DOUBLE * v[j] - {_STEP!r}::DOUBLE * g[j]) FROM (
   SELECT i, any_value(w) AS w, any_value(v) AS v, [{sums}] AS g FROM (
    SELECT *, (1 - h1 * h1) * (e1 * w[9] + e2 * w[10]) AS d1, (1 - h2 * h2) * (e1 * w[11] + e2 * w[12]) AS d2 FROM (
     SELECT *, p1 - CASE WHEN y = 0 THEN 1 ELSE 0 END AS e1, 1 - p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END AS e2 FROM (
      SELECT *, 1 / (1 + exp((w[8] + w[10] * h1 + w[12] * h2) - (w[7] + w[9] * h1 + w[11] * h2))) AS p1 FROM (
       SELECT it.*, r.*, tanh(w[1] + w[3] * a + w[5] * b) AS h1, tanh(w[2] + w[4] * a + w[6] * b) AS h2 FROM it, r WHERE i < {_ROUNDS}
      ))))
   GROUP BY i)
 )
SELECT CAST(j AS BIGINT) AS place, round(w[j] + CAST(1e-9 AS DOUBLE), 6) AS weight FROM it, range(1, 13) t(j) WHERE i = {_ROUNDS}"""


@query("perceptron_weights", _perceptron_sql())
def perceptron_weights(spark, sf):
    """Weights of a small net after a fixed number of rounds over the whole table."""
    rows = materialize(table(spark, sf, "lineitem").select(F.expr(_LATE).alias("y"), F.expr("array(l_quantity / 50, l_tax * 10)").alias("x")))
    model = perceptron(rows, "x", "y", hidden=(2,), alpha=_DECAY, activation="tanh", solver="gd", rate=_STEP, momentum=_MOMENTUM, rounds=_ROUNDS, tolerance=0.0, start=_START)
    out = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights, 1)], "place long, weight double")
    return out.select("place", r6("weight").alias("weight"))


# ---------------------------------------------------------------- regression trees per algorithm and fold

_TREE_X = ("accuracy", "f1", "fsize", "parameters", "train_running_time", "running_time")
_TREE_Y = ("train_power_draw", "power_draw")


def _tree_levels():
    """All trees level by level: sums in order of each feature, the best cut of each node, the rows' next nodes."""
    text = f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS id, model, environment, CAST(concat('0x', substr(md5(dataset), 1, 8)) AS BIGINT) % 5 AS fold, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _TREE_X)}] AS x, [{', '.join(_TREE_Y)}] AS y
   FROM meas WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*_TREE_X, *_TREE_Y))}),
 given AS MATERIALIZED (SELECT r.id, r.model, f.fold, t.target, r.fold <> f.fold AS train, r.x, r.y[t.target + 1] AS y FROM rows r JOIN (SELECT DISTINCT model, fold FROM rows) f ON f.model = r.model, range({len(_TREE_Y)}) t(target)),
 root AS (SELECT model, fold, target, sum(y * y) - sum(y) * sum(y) / count(*) AS squares FROM given WHERE train GROUP BY ALL),
 a0 AS MATERIALIZED (SELECT *, CAST(1 AS BIGINT) AS node FROM given)"""
    k = "model, fold, target, node"
    for d in range(DEPTH):
        text += f""",
 v{d} AS (SELECT {k}, f, v, count(*) AS n, sum(y) AS s FROM (SELECT {k}, y, unnest(x) AS v, unnest(range(len(x))) AS f FROM a{d} WHERE train AND node >= {2 ** d}) GROUP BY ALL),
 c{d} AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER g AS an, sum(s) OVER g AS sa, lead(v) OVER w AS next FROM v{d} WINDOW w AS (PARTITION BY {k}, f ORDER BY v), g AS (PARTITION BY {k}, f)),
 b{d} AS MATERIALIZED (SELECT {k}, f, (v + next) / 2 AS cut FROM (SELECT c.*, round((ls * ls / ln + (sa - ls) * (sa - ls) / (an - ln) - sa * sa / an) / squares, 9) AS gain FROM c{d} c JOIN root USING (model, fold, target) WHERE next IS NOT NULL)
   WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY gain DESC, f, v) = 1),
 a{d + 1} AS MATERIALIZED (SELECT a.* EXCLUDE node, CASE WHEN b.f IS NULL THEN a.node WHEN a.x[b.f + 1] > b.cut THEN 2 * a.node + 1 ELSE 2 * a.node END AS node FROM a{d} a LEFT JOIN b{d} b USING ({k}))"""
    return text


@query("tree_regressor", f"""WITH {S.MEAS}, {_tree_levels()},
 leaf AS (SELECT model, fold, target, node, avg(y) AS value FROM a{DEPTH} WHERE train GROUP BY ALL),
 err AS (SELECT a.model, a.target, abs(l.value - a.y) AS err FROM a{DEPTH} a JOIN leaf l USING (model, fold, target, node) WHERE NOT a.train)
SELECT model, CAST(target AS INTEGER) AS target, round(avg(err) + CAST(1e-9 AS DOUBLE), 6) AS mae, round(stddev_samp(err) + CAST(1e-9 AS DOUBLE), 6) AS std, round(max(err) + CAST(1e-9 AS DOUBLE), 6) AS max_error FROM err GROUP BY ALL""")
def tree_regressor(spark, sf):
    """Held-out errors of regression trees per algorithm and fold of data sets."""
    whole = meas(spark, sf).dropna(subset=[*_TREE_X, *_TREE_Y])
    rows = materialize(whole.select(
        "model", F.expr("CAST(conv(substr(md5(dataset), 1, 8), 16, 10) AS BIGINT) % 5").cast("int").alias("fold"),
        F.array(*[F.col(c).cast("double") for c in _TREE_X]).alias("x"), F.array(*_TREE_Y).alias("y"),
    ))
    trees = fold_trees(cell_sums(rows, ["model", "fold"], "x", "y", len(_TREE_Y)), ["model"], "fold")
    found = rows.join(trees, ["model", "fold"]).select(
        "model", "target", (walk(F.col("x"), F.col("feature"), F.col("threshold"), F.col("value")) - F.get("y", F.col("target"))).alias("err")
    )
    errors = error_summary(found, "err", ["model", "target"])
    return errors.select("model", "target", *[r6(c).alias(c) for c in ("mae", "std", "max_error")])


# ---------------------------------------------------------------- a search in two runs

_SEARCHED = ("GNB", "kNN")
_SETTINGS = {m: draw_settings(METHODS[m].grid, 50) for m in _SEARCHED}
_nb_settings = ", ".join(f"({i}, '{json.dumps(s)}', {S.dbl(s['var_smoothing'])})" for i, s in enumerate(_SETTINGS["GNB"]))
_knn_settings = ", ".join(f"({i}, '{json.dumps(s)}', {s['n_neighbors']}, {s['p']})" for i, s in enumerate(_SETTINGS["kNN"]))


@query("search_resumed", f"""WITH e AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda v : CAST(v AS DOUBLE)) AS x,
  (row_number() OVER (PARTITION BY label ORDER BY substr(md5(concat(vec_id, '-42')), 1, 13), vec_id) - 1) % 5 AS fold FROM embeddings),
 f AS (SELECT DISTINCT fold FROM e),
 u AS MATERIALIZED (SELECT f.fold AS f, e.fold, id, label, unnest(x) AS v, unnest(range(len(x))) AS j FROM e, f),
 c AS MATERIALIZED (SELECT f, label, any_value(n) AS n, list(m ORDER BY j) AS m, list(s ORDER BY j) AS s FROM (SELECT f, label, j, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM u WHERE fold <> f GROUP BY ALL) GROUP BY f, label),
 sd AS MATERIALIZED (SELECT f, j, avg(v) AS m, var_pop(v) AS vp, CASE WHEN stddev_pop(v) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(v) END AS s FROM u WHERE fold <> f GROUP BY ALL),
 ev AS (SELECT f, max(vp) AS eps FROM sd GROUP BY f), total AS (SELECT f, sum(n)::DOUBLE AS total FROM c GROUP BY f),
 g(pos, params, a) AS (VALUES {_nb_settings}),
 nb AS (SELECT 'GNB' AS method, g.pos, g.params, e.fold, e.id, e.label, arg_max(c.label, row(round(ln(c.n / total) - 0.5::DOUBLE * list_sum(list_transform(range(1, len(x) + 1),
   lambda i : ln(2 * pi() * (c.s[i] + g.a * eps)) + (x[i] - c.m[i]) * (x[i] - c.m[i]) / (c.s[i] + g.a * eps))), 9), -c.label)) AS pred
  FROM e JOIN c ON c.f = e.fold JOIN ev ON ev.f = e.fold JOIN total ON total.f = e.fold, g GROUP BY ALL),
 z AS MATERIALIZED (SELECT u.f, u.fold, id, label, list((v - m) / s ORDER BY u.j) AS z FROM u JOIN sd ON sd.f = u.f AND sd.j = u.j GROUP BY ALL),
 d AS MATERIALIZED (SELECT q.f, q.id, q.label, t.id AS did, t.label AS dl, p, round(power(list_sum(list_transform(range(1, len(q.z) + 1), lambda i : power(abs(q.z[i] - t.z[i]), p))), 1.0::DOUBLE / p), 9) AS dist
  FROM z q JOIN z t ON t.f = q.f AND t.fold <> q.f, (VALUES (1), (2), (3)) ps(p) WHERE q.fold = q.f),
 near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY dist, did) AS nth FROM d QUALIFY nth <= 50),
 k(pos, params, n, p) AS (VALUES {_knn_settings}),
 votes AS (SELECT k.pos, k.params, f, id, label, dl, count(*) AS votes FROM near JOIN k ON k.p = near.p AND nth <= k.n GROUP BY ALL),
 knn AS (SELECT 'kNN' AS method, pos, params, f AS fold, id, label, arg_max(dl, row(votes, -dl)) AS pred FROM votes GROUP BY ALL),
 per AS (SELECT method, pos, params, fold, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM (SELECT * FROM nb UNION ALL SELECT * FROM knn) GROUP BY ALL),
 s AS (SELECT method, CAST(pos AS INTEGER) AS pos, params, round(avg(score) + CAST(1e-9 AS DOUBLE), 6) AS mean_test_score, round(stddev_pop(score) + CAST(1e-9 AS DOUBLE), 6) AS std_test_score FROM per GROUP BY ALL)
SELECT 'embeddings' AS dataset, *, CAST(floor(rank() OVER (PARTITION BY method ORDER BY mean_test_score DESC) + (count(*) OVER (PARTITION BY method, mean_test_score) - 1) / 2) AS INTEGER) AS rank_test_score FROM s""")
def search_resumed(spark, sf):
    """Scores of drawn settings, searched in two runs with one store: the second skips what the first has finished."""
    rows, store = table(spark, sf, "embeddings"), new_stage(spark)
    for names in (_SEARCHED[:1], _SEARCHED):
        found = search(rows, "embedding", "label", "vec_id", store, "embeddings", {m: METHODS[m] for m in names})
    settled = found.withColumns({c: r6(c) for c in ("mean_test_score", "std_test_score")})
    return average_rank(settled)
