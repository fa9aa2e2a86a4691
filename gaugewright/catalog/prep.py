"""Queries: tabular preparation, folds and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.catalog.ingest import meas
from gaugewright.meta import PROPERTY_KEYS
from gaugewright.operators.hashing import hashed_neighbours
from gaugewright.operators import prep as T
from gaugewright.operators.clean import complete_rows, drop_implausible_power
from gaugewright.operators.folds import group_kfold
from gaugewright.operators.neighbours import knn_classify, knn_impute
from gaugewright.session import materialize
from gaugewright.sources.views import table

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_hot = ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{v}\"" for v in _PRIORITIES)
_hot2 = ", ".join(f"CASE WHEN s = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"s_{v}\"" for v in "FO")


@query("one_hot", f"SELECT o_orderkey, {_hot}, {_hot2} FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders)")
def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return T.one_hot(orders, {"o_orderpriority": _PRIORITIES, "s": "FO"})


@query("category_codes", """WITH t AS (SELECT o_orderkey, concat('c', o_custkey) AS customer, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders),
 c AS (SELECT customer, row_number() OVER (ORDER BY customer) - 1 AS code FROM (SELECT DISTINCT customer FROM t)),
 k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM t WHERE s IS NOT NULL))
SELECT o_orderkey, c.code AS customer, coalesce(k.code, -1) AS s FROM t JOIN c USING (customer) LEFT JOIN k USING (s)""")
def category_codes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("customer"), F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return T.category_codes(orders, ["customer", "s"])


@query("factorize", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN concat(o_orderpriority, o_custkey % 50) END AS label FROM orders),
 c AS (SELECT label, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS code FROM t WHERE label IS NOT NULL GROUP BY label)
SELECT t.o_orderkey, coalesce(c.code, -1) AS code FROM t LEFT JOIN c ON t.label = c.label""")
def factorize(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.col("o_custkey") % 50)).alias("label")
    )
    return T.factorize(orders, "label", "o_orderkey").select("o_orderkey", "code")


_GAPPY = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_suppkey % 7 = 2 THEN NULL ELSE l_extendedprice END AS price, l_tax AS tax"


@query("median_impute", f"""WITH t AS (SELECT {', '.join(LINE_ID)}, {_GAPPY} FROM lineitem)
SELECT {', '.join(LINE_ID)}, coalesce(qty, (SELECT median(qty) FROM t)) AS qty, round(coalesce(price, (SELECT median(price) FROM t)) + CAST(1e-9 AS DOUBLE), 6) AS price, tax FROM t""")
def median_impute(spark, sf):
    gappy = table(spark, sf, "lineitem").selectExpr(*LINE_ID, *[e.strip() for e in _GAPPY.split(", CASE")[:1]], "CASE" + _GAPPY.split(", CASE")[1].split(", l_tax")[0], "l_tax AS tax")
    return T.median_impute(gappy, ["qty", "price", "tax"]).withColumn("price", r6("price"))


@query("train_test_split", """SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5(concat(o_orderkey, '-42')), 1, 13)) <= ceil(count(*) OVER () * CAST(0.25 AS DOUBLE)) AS is_test FROM orders""")
def train_test_split(spark, sf):
    return T.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("feature_variants", """WITH f AS (SELECT DISTINCT l_returnflag AS dataset, concat('feat_', l_suppkey) AS feature FROM lineitem),
 v AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY dataset ORDER BY md5(concat(feature, '-430286')), feature) - 1 AS INTEGER) AS variant FROM f)
SELECT *, concat('v', variant, '_5___', dataset) AS variant_name FROM v""")
def feature_variants(spark, sf):
    features = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.concat(F.lit("feat_"), "l_suppkey").alias("feature")).distinct()
    return T.feature_variants(features, 5)


@query("group_kfold", """WITH RECURSIVE g AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name DESC) AS rn FROM (SELECT concat(p_brand, '/', p_type) AS name, count(*) AS n FROM part GROUP BY 1)),
 step AS (SELECT rn, name, n, 1 AS fold, [n, 0, 0, 0, 0] AS loads FROM g WHERE rn = 1
  UNION ALL SELECT g.rn, g.name, g.n, list_position(s.loads, list_min(s.loads)),
   list_transform(s.loads, lambda x, i : CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN x + g.n ELSE x END) FROM step s JOIN g ON g.rn = s.rn + 1)
SELECT name, n, CAST(fold - 1 AS INTEGER) AS fold FROM step""")
def folds(spark, sf):
    return group_kfold(table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("name")), "name")


_ST = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("standardize", f"SELECT {', '.join(LINE_ID)}, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () + CAST(1e-9 AS DOUBLE), 6) AS {c}" for c in _ST) + " FROM lineitem")
def standardize(spark, sf):
    scaled = T.standardize(table(spark, sf, "lineitem").select(*LINE_ID, *_ST), list(_ST))
    return scaled.select(*LINE_ID, *[r6(c).alias(c) for c in _ST])


# ---------------------------------------------------------------- nearest neighbours

_NUM = ("n_results", *PROPERTY_KEYS)
_num_rows = "m.accuracy IS NOT NULL AND m.precision IS NOT NULL AND m.recall IS NOT NULL"
_common = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _NUM)
_square = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in _NUM)


def _fill_sql(target):
    return f"""{target}_d AS (SELECT q.rid, d.{target} AS v, row_number() OVER (PARTITION BY q.rid ORDER BY round(sqrt(CAST(({_square}) AS DOUBLE) * {len(_NUM)} / ({_common})), 9), d.rid) AS rn
  FROM c q JOIN c d ON q.{target} IS NULL AND d.{target} IS NOT NULL), {target}_f AS (SELECT rid, avg(v) AS v FROM {target}_d WHERE rn <= 10 GROUP BY rid)"""


# energy of line items with few, expensive parts counts as implausible here: 30 times the usual rate
_LIMIT = 53.0


@query("knn_impute", f"""WITH {S.MEAS}, c AS (SELECT concat(configuration, ' @ ', environment) AS rid, n_results, {', '.join(p for p in PROPERTY_KEYS if 'power' not in p)},
  CASE WHEN train_power_draw > {_LIMIT} * train_running_time THEN NULL ELSE train_power_draw END AS train_power_draw,
  CASE WHEN power_draw > 7 * running_time THEN NULL ELSE power_draw END AS power_draw FROM meas m WHERE {_num_rows}),
 {_fill_sql('train_power_draw')}, {_fill_sql('power_draw')}
SELECT c.rid, round(coalesce(c.train_power_draw, t.v, (SELECT avg(train_power_draw) FROM c)) + CAST(1e-9 AS DOUBLE), 6) AS train_power_draw, round(coalesce(c.power_draw, p.v, (SELECT avg(power_draw) FROM c)) + CAST(1e-9 AS DOUBLE), 6) AS power_draw
FROM c LEFT JOIN train_power_draw_f t ON c.rid = t.rid LEFT JOIN power_draw_f p ON c.rid = p.rid""")
def gap_filling(spark, sf):
    complete = complete_rows(meas(spark, sf), PROPERTY_KEYS).withColumn("rid", F.concat_ws(" @ ", "configuration", "environment"))
    gappy = complete.withColumns({
        "train_power_draw": F.expr(f"CASE WHEN train_power_draw > double({_LIMIT}) * train_running_time THEN NULL ELSE train_power_draw END"),
        "power_draw": F.expr("CASE WHEN power_draw > 7 * running_time THEN NULL ELSE power_draw END"),
    })
    filled = knn_impute(materialize(gappy.select("rid", *_NUM)), "rid", list(_NUM))
    return filled.select("rid", r6("train_power_draw").alias("train_power_draw"), r6("power_draw").alias("power_draw"))


_dims = 64
_z = ", ".join(f"(e{i} - avg(e{i}) OVER ()) / stddev_pop(e{i}) OVER () AS z{i}" for i in range(1, _dims + 1))


@query("knn_classify", f"""WITH s AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY substr(md5(concat(vec_id, '-42')), 1, 13)) <= ceil(count(*) OVER () * CAST(0.25 AS DOUBLE)) AS is_test FROM embeddings),
 u AS (SELECT vec_id, label, is_test, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM s),
 st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM u WHERE NOT is_test GROUP BY i),
 z AS (SELECT vec_id, any_value(label) AS label, any_value(is_test) AS is_test, list((v - m) / sd ORDER BY u.i) AS z FROM u JOIN st ON u.i = st.i GROUP BY vec_id),
 n AS (SELECT q.vec_id, d.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.z, d.z), 9), d.vec_id) AS rn FROM z q JOIN z d ON q.is_test AND NOT d.is_test),
 v AS (SELECT vec_id, label, count(*) AS votes FROM n WHERE rn <= 5 GROUP BY vec_id, label)
SELECT vec_id, arg_min(label, row(-votes, label)) AS pred FROM v GROUP BY vec_id""")
def nearest_classes(spark, sf):
    train, test = scaled_embeddings(spark, sf)
    return knn_classify(train, test, "z", "label", "vec_id", k=5, width=_dims)


def scaled_embeddings(spark, sf):
    """Train and test part of the embedding table, standardized with the statistics of the train part."""
    split = T.train_test_split(table(spark, sf, "embeddings"), "vec_id")
    wide = split.select("vec_id", "label", "is_test", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(_dims)])
    names = [f"e{i}" for i in range(_dims)]
    stats = wide.filter("NOT is_test").agg(*[F.avg(c).alias(f"{c}m") for c in names], *[F.stddev_pop(c).alias(f"{c}s") for c in names]).first()
    z = F.array(*[(F.col(c) - stats[f"{c}m"]) / (stats[f"{c}s"] or 1.0) for c in names])
    scaled = materialize(wide.select("vec_id", "label", "is_test", z.alias("z")))
    return scaled.filter("NOT is_test").drop("is_test"), scaled.filter("is_test").drop("is_test")


_LSH = {"tables": 8, "signs": 6, "flips": 4}


@query("knn_lsh", f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda v : CAST(v AS DOUBLE)) AS x, row_number() OVER (ORDER BY substr(md5(concat(vec_id, '-42')), 1, 13)) <= ceil(count(*) OVER () * CAST(0.25 AS DOUBLE)) AS is_test FROM embeddings),
 u AS (SELECT vec_id, is_test, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s), st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM u WHERE NOT is_test GROUP BY i),
 z AS MATERIALIZED (SELECT vec_id, any_value(is_test) AS is_test, list((v - m) / sd ORDER BY u.i) AS z FROM u JOIN st ON u.i = st.i GROUP BY vec_id),
 dirs AS MATERIALIZED (SELECT d, list(CAST(concat('0x', substr(md5(concat(d, '-', j)), 1, 8)) AS BIGINT) % 2001 / CAST(1000 AS DOUBLE) - 1 ORDER BY j) AS r FROM range({_LSH["tables"] * _LSH["signs"]}) a(d), range({_dims}) b(j) GROUP BY d),
 p AS (SELECT vec_id, is_test, d // {_LSH["signs"]} AS tbl, d % {_LSH["signs"]} AS b, list_dot_product(z, r) AS dot FROM z, dirs),
 c AS MATERIALIZED (SELECT vec_id, is_test, tbl, CAST(sum(CASE WHEN dot > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS bucket, list(CAST(1 << b AS BIGINT) ORDER BY abs(dot), b)[1:{_LSH["flips"]}] AS unsure FROM p GROUP BY ALL),
 asked AS (SELECT vec_id, tbl, xor(bucket, CAST(list_sum(list_transform(range({_LSH["flips"]}), lambda i : CASE WHEN (m >> i) & 1 = 1 THEN unsure[i + 1] ELSE 0 END)) AS BIGINT)) AS bucket FROM c, range({2 ** _LSH["flips"]}) t(m) WHERE is_test AND bit_count(m) <= 2),
 pairs AS (SELECT DISTINCT a.vec_id, c.vec_id AS neighbour FROM asked a JOIN c ON c.tbl = a.tbl AND c.bucket = a.bucket AND NOT c.is_test),
 n AS (SELECT p.*, round(list_distance(q.z, d.z), 9) AS dist FROM pairs p JOIN z q ON q.vec_id = p.vec_id JOIN z d ON d.vec_id = p.neighbour)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS INTEGER) AS rank, neighbour, round(dist, 6) AS dist FROM n QUALIFY rank <= 5""")
def hashed(spark, sf):
    """Nearest training vectors of the test vectors from the buckets that each looks into."""
    train, test = scaled_embeddings(spark, sf)
    found = hashed_neighbours(test, train, "z", "vec_id", _dims, 5, **_LSH)
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("dist", 6).alias("dist"))
