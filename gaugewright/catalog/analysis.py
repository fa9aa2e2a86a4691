"""Queries: comparisons, correlations, scores, searches, meta-features, recommendations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.catalog.ingest import meas
from gaugewright.catalog.rating import shared_table
from gaugewright.functions.names import base_dataset
from gaugewright.meta import DEFAULT_PROPERTIES as PROPS
from gaugewright.meta import GROUP_KEYS, PROPERTY_KEYS
from gaugewright.operators import compare as P
from gaugewright.operators import scores as R
from gaugewright.operators import search as H
from gaugewright.operators.compound import add_scores
from gaugewright.operators.correlation import correlation_matrix, pair_correlations
from gaugewright.operators.energy import run_energy
from gaugewright.operators.index import idx, long_cells
from gaugewright.operators.metafeatures import STATISTICAL, profile, statistical
from gaugewright.plans import recommend as L
from gaugewright.session import materialize
from gaugewright.sources.files import combine_metafeatures
from gaugewright.sources.views import runs, table

ROW = ["dataset", "task", "environment", "model"]


def rated(spark, sf):
    """Rated and shared cells with scores, written once because several branches read it."""
    return materialize(add_scores(shared_table(spark, sf)[0], PROPS))


# ---------------------------------------------------------------- comparisons

_REFS = f"""ref_rows AS (SELECT {S.G}, property, arg_min(value, row(-index, configuration)) FILTER (index IS NOT NULL) AS ref FROM rated GROUP BY {S.G}, property)"""


@query("reference_values", f"WITH {S.RATED}, {_REFS} SELECT r.dataset, r.task, r.environment, r.model, r.property, r.index, f.ref FROM rated r JOIN ref_rows f USING ({S.G}, property) WHERE r.index IS NOT NULL")
def reference_values(spark, sf):
    cells = shared_table(spark, sf)[0]
    joined = cells.join(P.reference_values(cells, PROPS), list(GROUP_KEYS))
    entries = F.array(*[
        F.struct(F.lit(p).alias("property"), F.col(idx(p)).alias("index"), F.col(f"{p}__ref").alias("ref")) for p in PROPERTY_KEYS
    ])
    return joined.select(*ROW, F.inline(entries)).filter("index IS NOT NULL")


@query("attach_metafeatures", f"""WITH {S.MEAS}, mf AS (SELECT p_brand AS dataset, count(*) AS n_parts, round(avg(p_size) + CAST(1e-9 AS DOUBLE), 6) AS mean_size FROM part WHERE p_brand NOT LIKE '%3' GROUP BY p_brand)
SELECT m.dataset, m.task, m.environment, m.model, m.accuracy, mf.n_parts, mf.mean_size FROM meas m LEFT JOIN mf ON m.dataset = mf.dataset""")
def attach_metafeatures(spark, sf):
    features = table(spark, sf, "part").filter("p_brand NOT LIKE '%3'").groupBy(F.col("p_brand").alias("dataset")).agg(
        F.count("*").alias("n_parts"), r6(F.avg("p_size")).alias("mean_size")
    )
    return meas(spark, sf).select(*ROW, "accuracy").join(features, "dataset", "left")


_HANDLED = "handled AS (SELECT DISTINCT dataset FROM meas WHERE model = 'M9' AND n_results > 50)"


def handled(df):
    return df.filter("model = 'M9' AND n_results > 50").select("dataset").distinct()


@query("semi_split", f"WITH {S.MEAS}, {_HANDLED} SELECT configuration, environment, accuracy FROM meas WHERE dataset IN (SELECT dataset FROM handled)")
def semi_split(spark, sf):
    df = meas(spark, sf)
    return df.join(handled(df), "dataset", "left_semi").select("configuration", "environment", "accuracy")


@query("anti_split", f"WITH {S.MEAS}, {_HANDLED} SELECT configuration, environment, accuracy FROM meas WHERE dataset NOT IN (SELECT dataset FROM handled)")
def anti_split(spark, sf):
    df = meas(spark, sf)
    return df.join(handled(df), "dataset", "left_anti").select("configuration", "environment", "accuracy")


@query("env_pairs", f"""WITH {S.MEAS}, o AS (SELECT dataset, task, model, environment AS environment_from, train_power_draw AS train_power_draw_from, accuracy AS accuracy_from,
 lead(environment) OVER w AS environment_to, lead(train_power_draw) OVER w AS train_power_draw_to, lead(accuracy) OVER w AS accuracy_to
 FROM meas WINDOW w AS (PARTITION BY dataset, task, model ORDER BY environment)) SELECT * FROM o WHERE environment_to IS NOT NULL""")
def env_pairs(spark, sf):
    return P.chain(meas(spark, sf), ["dataset", "task", "model"], "environment", ["train_power_draw", "accuracy"])


_spread = ", ".join(f"max(CASE WHEN property = '{p}' THEN s END) AS {p}" for p in PROPERTY_KEYS)
_SPREAD = f"""spread0 AS (SELECT dataset, model, property, stddev_samp(index) AS s FROM rated GROUP BY dataset, model, property),
 spread AS (SELECT dataset, model, {_spread}, CASE WHEN count(s) = count(*) THEN avg(s) END AS mean_spread FROM spread0 GROUP BY dataset, model)"""
_spread6 = ", ".join(f"round({p} + CAST(1e-9 AS DOUBLE), 6) AS {p}" for p in (*PROPERTY_KEYS, "mean_spread"))


@query("env_spread", f"WITH {S.RATED}, {_SPREAD} SELECT dataset, model, {_spread6} FROM spread")
def env_spread(spark, sf):
    found = P.environment_spread(shared_table(spark, sf)[0], PROPS)
    return found.select("dataset", "model", *[r6(c).alias(c) for c in (*PROPERTY_KEYS, "mean_spread")])


def _base_spread(spark, sf):
    found = P.environment_spread(shared_table(spark, sf)[0], PROPS).filter("mean_spread IS NOT NULL")
    base_only = found.filter(base_dataset(F.col("dataset")) == F.col("dataset"))
    return base_only.select("dataset", "model", r6("mean_spread").alias("mean_spread"))


@query("spread_top10", f"""WITH {S.RATED}, {_SPREAD} SELECT dataset, model, round(mean_spread + CAST(1e-9 AS DOUBLE), 6) AS mean_spread FROM spread
 WHERE mean_spread IS NOT NULL AND NOT regexp_matches(dataset, '^v\\d_\\d___') ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def spread_top10(spark, sf):
    return _base_spread(spark, sf).orderBy(F.desc("mean_spread"), "dataset", "model").limit(10)


@query("spread_bottom10", f"""WITH {S.RATED}, {_SPREAD} SELECT dataset, model, round(mean_spread + CAST(1e-9 AS DOUBLE), 6) AS mean_spread FROM spread
 WHERE mean_spread IS NOT NULL AND NOT regexp_matches(dataset, '^v\\d_\\d___') ORDER BY 3, 1, 2 LIMIT 10""")
def spread_bottom10(spark, sf):
    return _base_spread(spark, sf).orderBy("mean_spread", "dataset", "model").limit(10)


@query("minmax_normalize", f"""WITH {S.SCORED} SELECT {S.G}, model, round((compound_index - min(compound_index) OVER w) / nullif(max(compound_index) OVER w - min(compound_index) OVER w, 0) + CAST(1e-9 AS DOUBLE), 6) AS shade
 FROM scored WINDOW w AS (PARTITION BY dataset, task)""")
def minmax(spark, sf):
    return P.min_max(rated(spark, sf).select(*ROW, "compound_index"), ["dataset", "task"], "compound_index", "shade").select(
        *ROW, r6("shade").alias("shade")
    )


@query("top1_per_group", f"""WITH {S.MEAS} SELECT environment, dataset, model, configuration, accuracy FROM (SELECT *,
 row_number() OVER (PARTITION BY environment, dataset ORDER BY accuracy DESC, model, configuration) AS rn FROM meas) WHERE rn = 1""")
def top1(spark, sf):
    return P.top_per_group(meas(spark, sf), ["environment", "dataset"], "accuracy", ["model", "configuration"], ["model", "configuration"])


@query("model_union", f"WITH {S.MEAS} SELECT model, environment FROM meas WHERE task = 'A' UNION SELECT model, environment FROM meas WHERE accuracy > 0.95")
def model_union(spark, sf):
    df = meas(spark, sf).select("model", "environment", "task", "accuracy")
    return df.filter("task = 'A'").select("model", "environment").union(
        df.filter("accuracy > 0.95").select("model", "environment")
    ).distinct()


@query("stack_scales", f"""WITH {S.RATED} SELECT scale, dataset, model, count(v) AS n, round(avg(v) + CAST(1e-9 AS DOUBLE), 6) AS mean FROM (
 SELECT 'index' AS scale, dataset, model, index AS v FROM rated WHERE property = 'accuracy' UNION ALL
 SELECT 'value', dataset, model, value FROM rated WHERE property = 'accuracy' UNION ALL
 SELECT 'rating', dataset, model, CAST(rating AS DOUBLE) FROM rated WHERE property = 'accuracy') GROUP BY ALL""")
def stack_scales(spark, sf):
    df = rated(spark, sf)
    frames = [
        df.select(F.lit(scale).alias("scale"), "dataset", "model", F.col(column).cast("double").alias("v"))
        for scale, column in (("index", idx("accuracy")), ("value", "accuracy"), ("rating", "accuracy__rating"))
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("scale", "dataset", "model").agg(
        F.count("v").alias("n"), r6(F.avg("v")).alias("mean")
    )


_diff_props = {p: {"parameters": 1e6, "fsize": 1e6, "train_power_draw": 1e3}.get(p, 1.0) for p in PROPERTY_KEYS}


@query("source_diff", f"WITH {S.RUNS} " + " UNION ALL ".join(
    f"SELECT architecture AS source, '{p}' AS property, count({p}) AS n, round(avg({p} / {S.dbl(k)}), 9) AS mean, round(stddev_samp({p} / {S.dbl(k)}), 9) AS std FROM runs GROUP BY architecture"
    for p, k in _diff_props.items()
))
def source_diff(spark, sf):
    cells = F.array(*[F.struct(F.lit(p).alias("property"), (F.col(p) / k).alias("v")) for p, k in _diff_props.items()])
    return runs(spark, sf).select(F.col("architecture").alias("source"), F.inline(cells)).groupBy("source", "property").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("std")
    )


# ---------------------------------------------------------------- correlations

_pair_values = ", ".join(f"('{a.key}', '{b.key}')" for a, b in combinations(PROPS, 2))


@query("correlations", f"""WITH {S.RATED}, z AS (SELECT configuration, environment, dataset, task, property, nullif(index, 0) AS i FROM rated),
 pairs AS (SELECT * FROM (VALUES {_pair_values}) AS t(a, b)),
 xy AS (SELECT x.dataset, x.task, p.a, p.b, x.i AS x, y.i AS y FROM pairs p JOIN z x ON x.property = p.a JOIN z y ON y.property = p.b AND y.configuration = x.configuration AND y.environment = x.environment)
SELECT dataset, task, a, b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n,
 CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 AND NOT isnan(corr(x, y)) THEN round(corr(x, y) + CAST(1e-9 AS DOUBLE), 6) END AS corr FROM xy GROUP BY dataset, task, a, b""")
def correlations(spark, sf):
    return pair_correlations(shared_table(spark, sf)[0], PROPS).withColumn("corr", r6("corr"))


_CM = PROPERTY_KEYS
_CM_ALL = " AND ".join(f"{p} IS NOT NULL" for p in _CM)


def _matrix_sql(a, b):
    if a == b:
        return f"SELECT '{a}' AS a, '{b}' AS b, CAST(0 AS DOUBLE) AS corr"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + CAST(1e-9 AS DOUBLE), 6) AS corr FROM runs WHERE {_CM_ALL}"


@query("correlation_matrix", f"WITH {S.RUNS} " + " UNION ALL ".join(_matrix_sql(a, b) for a in _CM for b in _CM))
def corr_matrix(spark, sf):
    return correlation_matrix(runs(spark, sf), _CM).withColumn("corr", r6("corr"))


# ---------------------------------------------------------------- scores


def _clf_sql(source, truth, pred, keys=""):
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""WITH t AS (SELECT {k}{truth} AS truth, {pred} AS pred FROM {source}),
 side AS (SELECT {k}truth AS class, 1 AS support, 0 AS predicted, CAST(truth = pred AS INTEGER) AS tp FROM t UNION ALL SELECT {k}pred, 0, 1, 0 FROM t),
 c AS (SELECT {k}class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM side GROUP BY {k}class)
SELECT {k}round(sum(tp) / sum(support) + CAST(1e-9 AS DOUBLE), 6) AS accuracy, round(sum(coalesce(tp / nullif(predicted, 0), 0) * support) / sum(support) + CAST(1e-9 AS DOUBLE), 6) AS precision,
 round(sum(coalesce(tp / nullif(support, 0), 0) * support) / sum(support) + CAST(1e-9 AS DOUBLE), 6) AS recall,
 round(sum(coalesce(2 * tp / nullif(predicted + support, 0), 0) * support) / sum(support) + CAST(1e-9 AS DOUBLE), 6) AS f1 FROM c {g}"""


def _round_scores(df, keys=()):
    return df.select(*keys, *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("clf_metrics", _clf_sql("labels", "quality", "toxic"))
def clf_metrics(spark, sf):
    return _round_scores(R.classification_scores(table(spark, sf, "labels"), "quality", "toxic"))


@query("clf_metrics_multi", _clf_sql("lineitem", "l_linenumber % 5", "l_suppkey % 4", "l_returnflag"))
def clf_metrics_multi(spark, sf):
    line = table(spark, sf, "lineitem").select("l_returnflag", F.expr("bigint(l_linenumber % 5)").alias("t"), F.expr("l_suppkey % 4").alias("p"))
    return _round_scores(R.classification_scores(line, "t", "p", ["l_returnflag"]), ["l_returnflag"])


_AHEAD = "len(list_filter(s, lambda x, i : x > s[label + 1] OR (x = s[label + 1] AND i > label + 1)))"


@query("topk_accuracy", f"""WITH s AS (SELECT label, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS s FROM embeddings), r AS (SELECT label, {_AHEAD} AS ahead FROM s)
SELECT label, count(*) AS n, round(avg(CASE WHEN ahead < 5 THEN 1.0 ELSE 0.0 END) + CAST(1e-9 AS DOUBLE), 6) AS top_5_accuracy,
 round(avg(CASE WHEN ahead < 10 THEN 1.0 ELSE 0.0 END) + CAST(1e-9 AS DOUBLE), 6) AS top_10_accuracy FROM r GROUP BY label""")
def topk_accuracy(spark, sf):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf, "embeddings").select("label", scores.alias("s"))
    rate = lambda k: r6(F.avg(R.in_top_k(F.col("s"), F.col("label"), k).cast("double")))
    return df.groupBy("label").agg(F.count("*").alias("n"), rate(5).alias("top_5_accuracy"), rate(10).alias("top_10_accuracy"))


# ---------------------------------------------------------------- searches

_SEARCH = """search AS (SELECT p_brand AS dataset, l_returnflag AS method, l_linenumber - 1 AS pos, concat('s', l_linenumber) AS params,
  CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN NULL ELSE round(avg(1 - l_discount) + CAST(1e-9 AS DOUBLE), 2) END AS mean_test_score
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag, l_linenumber),
 score AS (SELECT *, coalesce(mean_test_score, 0) AS s FROM search),
 ranked AS (SELECT *, CAST(rank() OVER w AS INTEGER) AS r_min, CAST(floor(rank() OVER w + (count(*) OVER (PARTITION BY dataset, method, s) - 1) / 2) AS INTEGER) AS r_avg
  FROM score WINDOW w AS (PARTITION BY dataset, method ORDER BY s DESC))"""


def search_table(spark, sf):
    line = runs(spark, sf).select("dataset", F.col("task").alias("method"), F.split_part("log_name", F.lit("_"), F.lit(2)).cast("int").alias("ln"), "accuracy")
    scores = line.groupBy("dataset", "method", "ln").agg(F.round(F.avg("accuracy") + 1e-9, 2).alias("m"))
    failed = (F.col("ln") == 6) & (F.col("method") == "R")
    return scores.select(
        "dataset", "method", (F.col("ln") - 1).alias("pos"), F.concat(F.lit("s"), "ln").alias("params"),
        F.when(failed, F.lit(float("nan"))).otherwise(F.col("m")).alias("mean_test_score"),
    )


@query("search_rank_avg", f"WITH {_SEARCH} SELECT dataset, method, pos, r_avg AS rank_test_score FROM ranked")
def search_rank_avg(spark, sf):
    return H.average_rank(search_table(spark, sf)).select("dataset", "method", "pos", "rank_test_score")


@query("search_rank_min", f"WITH {_SEARCH} SELECT dataset, method, pos, r_min AS rank_test_score FROM ranked")
def search_rank_min(spark, sf):
    return H.min_rank(search_table(spark, sf)).select("dataset", "method", "pos", "rank_test_score")


@query("best_params", f"WITH {_SEARCH} SELECT dataset, method, arg_min(params, row(r_avg, pos)) AS params FROM ranked GROUP BY dataset, method")
def best_params(spark, sf):
    return H.best_params(H.average_rank(search_table(spark, sf)))


@query("search_sensitivity", f"""WITH {_SEARCH} SELECT dataset, method, CASE WHEN count(mean_test_score) = count(*) THEN round(stddev_pop(mean_test_score) + CAST(1e-9 AS DOUBLE), 6) END AS sensitivity
 FROM search GROUP BY dataset, method""")
def search_sensitivity(spark, sf):
    return H.sensitivity(search_table(spark, sf)).withColumn("sensitivity", r6("sensitivity"))


_REGR = """errors AS (SELECT concat('M', l_suppkey % 10) AS model, l_returnflag AS property, concat('R', l_linenumber) AS regr, round(avg(abs(l_discount - l_tax)) + CAST(1e-9 AS DOUBLE), 6) AS mae FROM lineitem GROUP BY 1, 2, 3),
 chosen AS (SELECT model, property, arg_min(regr, row(mae, regr)) AS regr, min(mae) AS mae FROM errors GROUP BY model, property)"""


def _chosen(spark, sf):
    from gaugewright.plans.metalearn import select_regressor
    errors = table(spark, sf, "lineitem").groupBy(
        F.expr("concat('M', l_suppkey % 10)").alias("model"), F.col("l_returnflag").alias("property"),
        F.expr("concat('R', l_linenumber)").alias("regr"),
    ).agg(r6(F.avg(F.abs(F.col("l_discount") - F.col("l_tax")))).alias("mae"))
    return select_regressor(errors, ["model", "property"])


@query("select_regressor", f"WITH {_REGR} SELECT * FROM chosen")
def select_regressor_query(spark, sf):
    return _chosen(spark, sf)


@query("regressor_counts", f"WITH {_REGR} SELECT regr, count(*) AS n FROM chosen GROUP BY regr")
def regressor_counts(spark, sf):
    return _chosen(spark, sf).groupBy("regr").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- meta-features and energy

_FEATS = {
    "f_qty": "l_quantity", "f_price": "l_extendedprice / 1000", "f_disc": "l_discount", "f_tax": "l_tax",
    "f_first": "CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DOUBLE)", "f_open": "CAST(CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS DOUBLE)",
    "f_const": "CAST(7 AS DOUBLE)",
}
_feat_sql = ", ".join(f"{e} AS {f}" for f, e in _FEATS.items())
_mom_sql = " UNION ALL ".join(
    f"""SELECT dataset, '{f}' AS feature, count(*) AS n, count(DISTINCT {f}) AS nd, sum(CASE WHEN {f} <> 0 THEN 1 ELSE 0 END) / count(*) AS balance, avg({f}) AS mean, var_samp({f}) AS variance,
 CASE WHEN count(DISTINCT {f}) > 1 THEN skewness({f}) * (count(*) - 2) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) - 1)) END AS skewness,
 CASE WHEN count(DISTINCT {f}) > 1 THEN kurtosis_pop({f}) END AS kurtosis, min({f}) AS min, max({f}) AS max FROM t GROUP BY dataset"""
    for f in _FEATS
)
_agg_sql = ", ".join(
    f"round(coalesce({fn}(CASE WHEN nd <> 2 THEN {m} END), 0) + CAST(1e-9 AS DOUBLE), 6) AS {m}_{a}"
    for m in ("mean", "variance", "skewness", "kurtosis", "min", "max") for a, fn in (("mean", "avg"), ("std", "stddev_pop"))
)


def tabular(spark, sf):
    line = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    return line.select(F.col("p_brand").alias("dataset"), F.col("l_returnflag").alias("label"), *[F.expr(e).alias(f) for f, e in _FEATS.items()])


_COUNTS = ("n_instances", "n_predictors", "n_classes", "n_num", "n_onehot")


@query("mf_statistical", f"""WITH t AS (SELECT p_brand AS dataset, l_returnflag AS label, {_feat_sql} FROM lineitem JOIN part ON l_partkey = p_partkey),
 m AS ({_mom_sql}), c AS (SELECT dataset, count(*) AS n_classes, round(avg(n) + CAST(1e-9 AS DOUBLE), 6) AS class_freq_mean, round(stddev_pop(n) + CAST(1e-9 AS DOUBLE), 6) AS class_freq_std FROM (SELECT dataset, label, count(*) AS n FROM t GROUP BY ALL) GROUP BY dataset),
 f AS (SELECT dataset, max(n) AS n_instances, count(*) AS n_predictors, count(*) FILTER (nd <> 2) AS n_num, count(*) FILTER (nd = 2) AS n_onehot,
  round(avg(CASE WHEN nd = 2 THEN balance END) + CAST(1e-9 AS DOUBLE), 6) AS onehot_bal_mean, round(stddev_pop(CASE WHEN nd = 2 THEN balance END) + CAST(1e-9 AS DOUBLE), 6) AS onehot_bal_std,
  round(max(CASE WHEN nd = 2 THEN balance END) + CAST(1e-9 AS DOUBLE), 6) AS onehot_bal_max, round(min(CASE WHEN nd = 2 THEN balance END) + CAST(1e-9 AS DOUBLE), 6) AS onehot_bal_min, {_agg_sql} FROM m GROUP BY dataset)
SELECT f.*, c.* EXCLUDE (dataset), round(CASE WHEN n_onehot > 0 THEN n_num / n_onehot / n_predictors ELSE 1 END + CAST(1e-9 AS DOUBLE), 6) AS num_onehot_ratio FROM f JOIN c ON f.dataset = c.dataset""")
def mf_statistical(spark, sf):
    found = statistical(tabular(spark, sf), list(_FEATS), "label")
    return found.select("dataset", *[F.col(c) if c in _COUNTS else r6(c).alias(c) for c in STATISTICAL])


@query("dataset_profile", f"""WITH t AS (SELECT p_brand AS dataset, count(*) AS n, count(DISTINCT l_returnflag) AS n_classes, count(DISTINCT l_suppkey) AS n_features FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT *, round((n - ceil(n * CAST(0.25 AS DOUBLE))) / n + CAST(1e-9 AS DOUBLE), 6) AS train_share, CASE WHEN n_features > 100 THEN 5 WHEN n_features > 60 THEN 3 WHEN n_features > 40 THEN 2 END AS subsets FROM t""")
def dataset_profile(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = profile(line.withColumnRenamed("p_brand", "dataset"), "l_returnflag", F.count_distinct("l_suppkey"))
    return found.withColumn("train_share", r6("train_share"))


@query("run_energy", """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + CAST(1e-9 AS DOUBLE), 6) AS duration,
 round(avg(value) * (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3.6e9 * 1e6 + CAST(1e-9 AS DOUBLE), 6) AS energy_mwh, count(*) AS no_meas,
 round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)) + avg(value * 2) + CAST(1e-9 AS DOUBLE), 6) AS total_cpu, round(avg(value) + CAST(1e-9 AS DOUBLE), 6) AS value FROM events GROUP BY user_id""")
def energy_of_runs(spark, sf):
    samples = table(spark, sf, "events").select(
        "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("cpu1"), (F.col("value") * 2).alias("cpu2")
    )
    found = run_energy(samples, "user_id", "ts", "value", ["cpu1", "cpu2"], ["value"])
    return found.select(
        "user_id", r6("duration").alias("duration"), r6(F.col("energy_consumed") * 1e6).alias("energy_mwh"),
        "no_meas", r6("total_cpu").alias("total_cpu"), r6("value").alias("value"),
    )


# ---------------------------------------------------------------- predictions and recommendations

_PRED = """preds AS (SELECT configuration, dataset, task, environment, model, property, weight, maximize, value, index,
 round(greatest(least(index + ((n_results % 7) - 3) / CAST(100 AS DOUBLE), 1), 0), 9) AS pred FROM rated WHERE index IS NOT NULL)"""


def predictions(cells):
    """Predictions given for this analysis: measured indices moved by a few percent."""
    noise = ((F.col("n_results") % 7) - 3) / F.lit(100.0)
    long = long_cells(cells, PROPS, ["configuration", "n_results", *ROW], ("index",)).filter("index IS NOT NULL")
    from gaugewright.functions.scalars import clip01
    return long.withColumn("pred", F.round(clip01(F.col("index") + noise), 9)).drop("index", "n_results")


@query("truth_vs_pred", f"WITH {S.RATED}, {_PRED} SELECT configuration, environment, property, index AS truth, pred, round(pred - index, 9) AS err FROM preds")
def truth_vs_pred(spark, sf):
    df = rated(spark, sf)
    return L.with_truth(predictions(df), df, PROPS).select("configuration", "environment", "property", "truth", "pred", "err")


@query("error_summary", f"""WITH {S.RATED}, {_PRED} SELECT property, round(avg(abs(round(pred - index, 9))) + CAST(1e-9 AS DOUBLE), 6) AS mae, round(stddev_samp(abs(round(pred - index, 9))) + CAST(1e-9 AS DOUBLE), 6) AS std,
 round(max(abs(round(pred - index, 9))) + CAST(1e-9 AS DOUBLE), 6) AS max_error FROM preds GROUP BY property""")
def error_summary(spark, sf):
    df = rated(spark, sf)
    found = R.error_summary(L.with_truth(predictions(df), df, PROPS), "err", ["property"])
    return found.select("property", *[r6(c).alias(c) for c in ("mae", "std", "max_error")])


@query("recalc_values", f"""WITH {S.RATED}, {_PRED}, {_REFS} SELECT configuration, p.environment, property, round({S.back_case('pred')} + CAST(1e-9 AS DOUBLE), 6) AS pred_value,
 round(value - ({S.back_case('pred')}) + CAST(1e-9 AS DOUBLE), 6) AS err FROM preds p JOIN ref_rows r USING ({S.G}, property)""")
def recalc_values(spark, sf):
    df = rated(spark, sf)
    found = L.recalculate_values(predictions(df), df, P.reference_values(df, PROPS), PROPS)
    return found.select("configuration", "environment", "property", r6("pred_value").alias("pred_value"), r6("err").alias("err"))


_CPRED = f"""cpred AS (SELECT configuration, {S.G}, model, round(sum(weight * pred) / {S.dbl(sum(p.weight for p in PROPS))} + CAST(1e-12 AS DOUBLE), 9) AS compound_pred FROM preds GROUP BY configuration, {S.G}, model HAVING count(*) = {len(PROPS)})"""


@query("compound_pred", f"WITH {S.SCORED}, {_PRED}, {_CPRED} SELECT configuration, environment, compound_pred, round(s.compound_index - compound_pred, 9) AS err FROM cpred JOIN scored s USING (configuration, environment)")
def compound_pred(spark, sf):
    df = rated(spark, sf)
    found = L.compound_predictions(predictions(df), PROPS).join(df.select("configuration", "environment", "compound_index"), ["configuration", "environment"])
    return found.filter("compound_pred IS NOT NULL").select(
        "configuration", "environment", "compound_pred", F.round(F.col("compound_index") - F.col("compound_pred"), 9).alias("err")
    )


_OBJ = f"""objectives AS (SELECT configuration, {S.G}, model, property AS objective, index AS truth, pred FROM preds WHERE property IN ('accuracy', 'train_power_draw')
  UNION ALL SELECT configuration, {S.G}, model, 'compound_index', compound_index, compound_pred FROM cpred JOIN scored USING (configuration, {S.G}, model))"""
_BEST = """best AS (SELECT 'pred' AS kind, * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY objective, environment, dataset ORDER BY pred DESC, model, configuration) AS rn FROM objectives) WHERE rn = 1
  UNION ALL SELECT 'truth', * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY objective, environment, dataset ORDER BY truth DESC, model, configuration) AS rn FROM objectives) WHERE rn = 1)"""
_ALLBEST = f"WITH {S.SCORED}, {_PRED}, {_CPRED}, {_OBJ}, {_BEST}"


def objectives(df):
    """Truth and prediction of the three objectives per row."""
    pred = predictions(df)
    single = L.with_truth(pred.filter(F.col("property").isin("accuracy", "train_power_draw")), df, PROPS)
    compound = L.compound_predictions(pred, PROPS).filter("compound_pred IS NOT NULL").join(
        df.select("configuration", "environment", "compound_index"), ["configuration", "environment"]
    )
    columns = ["configuration", *ROW]
    return single.select(*columns, F.col("property").alias("objective"), "truth", "pred").unionByName(
        compound.select(*columns, F.lit("compound_index").alias("objective"), F.col("compound_index").alias("truth"), F.col("compound_pred").alias("pred"))
    )


def _best(objs, score):
    return P.top_per_group(objs, ["objective", "environment", "dataset"], score, ["model", "configuration"], ["model", "configuration"])


@query("recommend", f"{_ALLBEST} SELECT objective, environment, dataset, model, configuration, pred FROM best WHERE kind = 'pred'")
def recommend(spark, sf):
    return _best(objectives(rated(spark, sf)), "pred")


@query("recommended_cost", f"""{_ALLBEST} SELECT b.environment, b.dataset, b.model, m.accuracy, round(m.train_power_draw + m.power_draw + CAST(1e-9 AS DOUBLE), 6) AS energy
 FROM best b JOIN meas m ON b.environment = m.environment AND b.configuration = m.configuration WHERE kind = 'pred' AND objective = 'accuracy'""")
def recommended_cost(spark, sf):
    df = rated(spark, sf)
    best = _best(objectives(df).filter("objective = 'accuracy'"), "pred").select("environment", "dataset", "model", "configuration")
    measured = df.select("environment", "configuration", "accuracy", r6(P.energy()).alias("energy"))
    return best.join(measured, ["environment", "configuration"]).drop("configuration")


@query("best_model_counts", f"""{_ALLBEST}, grid AS (SELECT DISTINCT o.objective, k.kind, o.environment, o.model FROM objectives o, (VALUES ('pred'), ('truth')) AS k(kind))
SELECT g.objective, g.kind, g.environment, g.model, count(b.model) AS n FROM grid g LEFT JOIN best b USING (objective, kind, environment, model) GROUP BY ALL""")
def best_model_counts(spark, sf):
    objs = materialize(objectives(rated(spark, sf)))
    best = _best(objs, "truth").select("objective", F.lit("truth").alias("kind"), "environment", "model").unionByName(
        _best(objs, "pred").select("objective", F.lit("pred").alias("kind"), "environment", "model")
    )
    grid = objs.select("objective", "environment", "model").distinct().withColumn("kind", F.explode(F.array(F.lit("pred"), F.lit("truth"))))
    counts = best.groupBy("objective", "kind", "environment", "model").agg(F.count("*").alias("n"))
    return grid.join(counts, ["objective", "kind", "environment", "model"], "left").fillna(0, ["n"])


_q3 = lambda v, n: ", ".join(f"round(quantile_cont({v}, {q}) + CAST(1e-9 AS DOUBLE), 6) AS {n}_q{i + 1}" for i, q in enumerate(("0.25", "0.5", "0.75")))


@query("cost_comparison", f"""{_ALLBEST}, {_HANDLED}, rows AS (SELECT *, train_power_draw + power_draw AS energy FROM meas),
 costs AS (SELECT r.environment, r.dataset, 'OURS' AS source, r.accuracy, r.energy FROM best b JOIN rows r ON b.environment = r.environment AND b.configuration = r.configuration WHERE kind = 'pred' AND objective = 'accuracy' AND r.model NOT IN ('M8', 'M9')
  UNION ALL SELECT environment, dataset, 'EXH', max(accuracy), sum(energy) FROM rows WHERE model NOT IN ('M8', 'M9') GROUP BY environment, dataset
  UNION ALL SELECT environment, dataset, model, accuracy, energy FROM rows WHERE model IN ('M8', 'M9')),
 parts AS (SELECT CASE WHEN dataset IN (SELECT dataset FROM handled) THEN 'small' ELSE 'large' END AS part, * FROM costs)
SELECT part, environment, source, count(*) AS n, {_q3('accuracy', 'accuracy')}, {_q3('energy', 'energy')} FROM parts GROUP BY part, environment, source""")
def cost_comparison(spark, sf):
    df = rated(spark, sf)
    best = _best(objectives(df).filter("objective = 'accuracy'"), "pred")
    complete, base = df.filter("model NOT IN ('M8', 'M9')"), df.filter("model IN ('M8', 'M9')")
    costs = P.cost_rows(complete, best, base)
    small = handled(df).withColumn("part", F.lit("small"))
    costs = costs.join(small, "dataset", "left").fillna("large", ["part"])
    boxes = P.box_summary(costs, ["part", "environment", "source"], ["accuracy", "energy"])
    return boxes.groupBy("part", "environment", "source").agg(
        F.max("n").alias("n"),
        *[
            r6(F.max(F.when(F.col("measure") == m, F.col("q")[i]))).alias(f"{m}_q{i + 1}")
            for m in ("accuracy", "energy") for i in range(3)
        ],
    )
