"""Queries: logs, cleaning, splits, set operations, names and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.functions import names as N
from gaugewright.functions import units as U
from gaugewright.functions.scalars import letter
from gaugewright.meta import DEFAULT_PROPERTIES as PROPS
from gaugewright.meta import GROUP_KEYS, PROPERTY_KEYS, meta_frame
from gaugewright.operators import clean as K
from gaugewright.operators.cells import sub_table
from gaugewright.operators.index import idx, index_best, long_cells
from gaugewright.operators.relevant import relevant_metrics
from gaugewright.plans.rate import rate
from gaugewright.session import materialize
from gaugewright.sources.files import combine_metafeatures, densify
from gaugewright.sources.logs import extract_properties, new_runs
from gaugewright.sources.views import measurements, runs, table

ROW = ["dataset", "task", "environment", "model"]
BASE = ("M8", "M9")


def meas(spark, sf):
    return measurements(spark, sf)


# ---------------------------------------------------------------- logs

_CPU_SQL = """CASE p_size % 6 WHEN 0 THEN concat('Intel(R) Core(TM) i7-', 6700 + p_size, ' CPU @ 3.40GHz')
 WHEN 1 THEN '13th Gen Intel(R) Core(TM) i9-13900K' WHEN 2 THEN 'ARMv8 Processor rev 1 (v8l)'
 WHEN 3 THEN 'AMD Ryzen 7 3700X 8-Core Processor' WHEN 4 THEN concat('The AMD Ryzen ', p_size, ' Pro Processor')
 ELSE concat('Unknown chip nr. ', p_size) END"""
_SHORT_SQL = """CASE WHEN regexp_matches(cpu, '^.*(Intel)\\(R\\) \\S* (\\S*).*') THEN regexp_replace(cpu, '^.*(Intel)\\(R\\) \\S* (\\S*).*', '\\1 \\2')
 WHEN regexp_matches(cpu, '^\\S* (AMD) \\S* (\\S*) .*') THEN regexp_replace(cpu, '^\\S* (AMD) \\S* (\\S*) .*', '\\1 \\2')
 WHEN regexp_matches(cpu, '^(ARM\\S+) Processor (.*)') THEN regexp_replace(cpu, '^(ARM\\S+) Processor (.*)', '\\1 \\2')
 ELSE concat(substr(cpu, 1, 13), '..') END"""


def cpu_names():
    return F.expr(_CPU_SQL)


@query("hardware_names", f"""SELECT cpu, {_SHORT_SQL} AS short, count(*) AS n FROM (SELECT {_CPU_SQL} AS cpu FROM part) GROUP BY ALL""")
def hardware_names(spark, sf):
    return table(spark, sf, "part").select(cpu_names().alias("cpu")).groupBy(
        "cpu", N.hardware_name(F.col("cpu")).alias("short")
    ).agg(F.count("*").alias("n"))


_REQS_SQL = "[concat('numpy==1.', l_linenumber), concat(CASE WHEN l_linenumber % 3 = 0 THEN 'scikit-learn' WHEN l_linenumber % 3 = 1 THEN 'Scikit_Learn' ELSE 'scipy' END, '==1.', l_suppkey % 5, '.0')]"


@query("software_version", f"""WITH r AS (SELECT l_returnflag, list_filter({_REQS_SQL}, lambda x : replace(lower(split_part(x, '==', 1)), '-', '_') = 'scikit_learn') AS m FROM lineitem)
SELECT l_returnflag, concat('Scikit-learn ', coalesce(split_part(m[1], '==', 2), 'n.a.')) AS software, count(*) AS n FROM r GROUP BY ALL""")
def software_versions(spark, sf):
    line = table(spark, sf, "lineitem")
    reqs = F.expr(_REQS_SQL.replace("[", "array(").replace("]", ")"))
    return line.groupBy("l_returnflag", N.software_name("Scikit-learn", reqs).alias("software")).agg(F.count("*").alias("n"))


def run_logs(spark, sf):
    """Nested run logs built from line items, with missing inference rows and zero test sizes among them."""
    line = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )
    emission = lambda d, e: F.struct(F.col(d).alias("duration"), F.expr(e).alias("energy_consumed"))
    both = F.array(emission("l_quantity", "l_extendedprice / 1e8"), emission("l_discount", "l_tax / 1e4"))
    return line.select(
        F.concat_ws(
            "_", F.when(F.col("l_returnflag") == "R", "infer").otherwise("train"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ).alias("directory_name"),
        F.struct(F.col("p_brand").alias("ds"), F.expr("concat('M', l_suppkey % 10)").alias("method")).alias("config"),
        F.struct(
            F.struct(F.col("l_linenumber").cast("double").alias("params"), F.col("p_size").cast("double").alias("fsize")).alias("model"),
            F.struct(
                F.expr("1 - l_discount").alias("accuracy"), F.expr("1 - l_tax").alias("f1"),
                F.expr("if(l_quantity = 13, double('NaN'), l_quantity / 50)").alias("precision"),
                F.expr("l_linenumber / 7").alias("recall"),
            ).alias("metrics"),
            F.struct(F.struct(F.array(F.expr("bigint(l_linenumber - 1) * 10")).alias("test")).alias("shape")).alias("data"),
        ).alias("results"),
        F.struct(cpu_names().alias("Processor")).alias("execution_platform"),
        F.expr(_REQS_SQL.replace("[", "array(").replace("]", ")")).alias("requirements"),
        F.when(F.col("l_linestatus") == "F", F.slice(both, 1, 1)).otherwise(both).alias("emissions"),
    )


_test = "nullif((l_linenumber - 1) * 10, 0)"


@query("extract_properties", f"""WITH logs AS (SELECT *, {_CPU_SQL} AS cpu, {_REQS_SQL} AS reqs, l_returnflag <> 'R' AS tr, l_linestatus <> 'F' AS inf
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT concat_ws('_', CASE WHEN tr THEN 'train' ELSE 'infer' END, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS log_name,
 CASE WHEN tr THEN 'train' ELSE 'infer' END AS task, p_brand AS dataset, concat('M', l_suppkey % 10) AS model,
 {_SHORT_SQL} AS architecture,
 concat('Scikit-learn ', coalesce(split_part(list_filter(reqs, lambda x : replace(lower(split_part(x, '==', 1)), '-', '_') = 'scikit_learn')[1], '==', 2), 'n.a.')) AS software,
 CASE WHEN tr THEN l_quantity END AS train_running_time, CASE WHEN tr THEN round(l_extendedprice / 1e8 * 3.6e6 + CAST(1e-9 AS DOUBLE), 6) END AS train_power_draw,
 CASE WHEN tr AND inf THEN round(l_discount / {_test} + CAST(1e-9 AS DOUBLE), 6) END AS running_time, CASE WHEN tr AND inf THEN round(l_tax / 1e4 * 3.6e6 / {_test} + CAST(1e-9 AS DOUBLE), 6) END AS power_draw,
 CASE WHEN tr THEN CAST(l_linenumber AS DOUBLE) END AS parameters, CASE WHEN tr THEN CAST(p_size AS DOUBLE) END AS fsize,
 CASE WHEN tr THEN 1 - l_discount END AS accuracy, CASE WHEN tr THEN 1 - l_tax END AS f1,
 CASE WHEN tr AND l_quantity <> 13 THEN l_quantity / 50 END AS precision, CASE WHEN tr THEN l_linenumber / 7 END AS recall FROM logs""")
def extracted(spark, sf):
    flat = extract_properties(run_logs(spark, sf))
    return flat.withColumns({c: r6(c) for c in ("train_power_draw", "running_time", "power_draw")})


@query("incremental_ingest", f"""WITH {S.RUNS}, named AS (SELECT log_name, any_value(dataset) AS dataset, bool_or(architecture = 'Arch F') AS known FROM runs GROUP BY log_name)
SELECT dataset, count(*) FILTER (NOT known) AS n_new, count(*) AS n_total FROM named GROUP BY dataset""")
def incremental(spark, sf):
    every = runs(spark, sf).select("log_name", "dataset", "architecture")
    known = every.filter("architecture = 'Arch F'").dropDuplicates(["log_name"])
    fresh = new_runs(every, known, "log_name")
    return known.withColumn("new", F.lit(0)).unionByName(fresh.withColumn("new", F.lit(1))).groupBy("dataset").agg(
        F.sum("new").alias("n_new"), F.count("*").alias("n_total")
    )


@query("props_json_scan", """WITH t AS (SELECT event_type, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS p FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT json_valid(p)) AS n_bad,
 CAST(sum(CASE WHEN json_valid(p) THEN CAST(json_extract(p, '$.k') AS BIGINT) END) AS BIGINT) AS sum_k FROM t GROUP BY event_type""")
def json_scan(spark, sf):
    events = table(spark, sf, "events")
    broken = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    text = events.select("event_type", F.when(broken, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("p"))
    parsed = text.select(
        "event_type",
        F.from_json("p", "k bigint, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"),
    )
    return parsed.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("j._corrupt").alias("n_bad"),
        F.sum(F.when(F.col("j._corrupt").isNull(), F.col("j.k"))).alias("sum_k"),
    )


@query("load_sparse_pivot", f"""WITH {S.MEAS} SELECT configuration, environment AS machine, {', '.join(PROPERTY_KEYS)}, 'unknown' AS environment FROM meas""")
def sparse_pivot(spark, sf):
    wide = meas(spark, sf)
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in PROPERTY_KEYS])
    sparse = wide.select("configuration", F.col("environment").alias("machine"), F.inline(entries)).filter("value IS NOT NULL")
    return densify(sparse, ["configuration", "machine"], list(PROPERTY_KEYS))


@query("metafeatures_combined", """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS dataset, count(*) AS n_customers, round(avg(c_acctbal) + CAST(1e-9 AS DOUBLE), 6) AS cust_mean,
  round(coalesce(stddev_samp(c_acctbal), 0) + CAST(1e-9 AS DOUBLE), 6) AS cust_std FROM customer GROUP BY 1),
 s AS (SELECT CAST(s_nationkey AS VARCHAR) AS dataset, count(*) AS n_suppliers, round(coalesce(stddev_samp(s_acctbal), 0) + CAST(1e-9 AS DOUBLE), 6) AS supp_std FROM supplier GROUP BY 1)
SELECT coalesce(c.dataset, s.dataset) AS dataset, n_customers, cust_mean, cust_std, n_suppliers, supp_std FROM c FULL JOIN s ON c.dataset = s.dataset""")
def metafeatures(spark, sf):
    left = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("dataset")).agg(
        F.count("*").alias("n_customers"), r6(F.avg("c_acctbal")).alias("cust_mean"),
        r6(F.coalesce(F.stddev_samp("c_acctbal"), F.lit(0.0))).alias("cust_std"),
    )
    right = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("dataset")).agg(
        F.count("*").alias("n_suppliers"), r6(F.coalesce(F.stddev_samp("s_acctbal"), F.lit(0.0))).alias("supp_std"),
    )
    return combine_metafeatures(left, right)


# ---------------------------------------------------------------- cleaning


@query("power_outliers", f"""WITH {S.RUNS} SELECT log_name, CASE WHEN train_power_draw > 400 * train_running_time THEN NULL ELSE train_power_draw END AS train_power_draw,
 CASE WHEN power_draw > 400 * running_time THEN NULL ELSE power_draw END AS power_draw FROM runs""")
def power_outliers(spark, sf):
    return K.drop_implausible_power(runs(spark, sf)).select("log_name", "train_power_draw", "power_draw")


@query("clean_runs", f"""WITH {S.MEAS}, f AS (SELECT * REPLACE (coalesce(nullif(parameters, 0), 0) AS parameters) FROM meas)
SELECT {S.G}, model, {', '.join(PROPERTY_KEYS)} FROM f WHERE {' AND '.join(p + ' IS NOT NULL' for p in PROPERTY_KEYS)}""")
def clean(spark, sf):
    unknown = meas(spark, sf).withColumn("parameters", F.expr("nullif(parameters, 0)"))
    return K.complete_rows(unknown, PROPERTY_KEYS).select(*ROW, *PROPERTY_KEYS)


@query("override_join", f"""WITH {S.MEAS}, fix AS (SELECT 'M3' AS model, p_brand AS dataset, CAST(count(*) AS DOUBLE) AS parameters,
  CASE WHEN max(p_size) > 49 THEN CAST(max(p_size) AS DOUBLE) END AS fsize FROM part GROUP BY p_brand)
SELECT m.dataset, m.task, m.environment, m.model, coalesce(f.parameters, m.parameters) AS parameters, coalesce(f.fsize, m.fsize) AS fsize
FROM meas m LEFT JOIN fix f ON m.model = f.model AND m.dataset = f.dataset""")
def override(spark, sf):
    fix = table(spark, sf, "part").groupBy(F.lit("M3").alias("model"), F.col("p_brand").alias("dataset")).agg(
        F.count("*").cast("double").alias("parameters"),
        F.when(F.max("p_size") > 49, F.max("p_size").cast("double")).alias("fsize"),
    )
    return K.override_sizes(meas(spark, sf), fix).select(*ROW, "parameters", "fsize")


@query("union_databases", f"""WITH {S.MEAS} SELECT {S.G}, model, accuracy, CASE WHEN environment LIKE 'Arch F%' THEN NULL ELSE recall END AS recall,
 CASE WHEN environment LIKE 'Arch F%' THEN f1 END AS f1 FROM meas""")
def union(spark, sf):
    every = meas(spark, sf)
    first = every.filter("environment LIKE 'Arch F%'").select(*ROW, "accuracy", "f1")
    second = every.filter("environment NOT LIKE 'Arch F%'").select(*ROW, "recall", "accuracy")
    return K.union_databases(first, second)


@query("except_baselines", f"WITH {S.MEAS} SELECT configuration, environment, accuracy FROM meas WHERE model NOT IN ('M8', 'M9')")
def except_baselines(spark, sf):
    return K.split_models(meas(spark, sf), BASE)[1].select("configuration", "environment", "accuracy")


@query("split_subsets", f"""WITH {S.MEAS}, complete AS (SELECT * FROM meas WHERE model NOT IN ('M8', 'M9')),
 seen AS (SELECT dataset, min(concat(environment, configuration)) AS s FROM complete GROUP BY dataset),
 pos AS (SELECT dataset, row_number() OVER (ORDER BY s) AS p FROM seen),
 sub AS (SELECT dataset FROM pos WHERE p BETWEEN 6 AND 15 UNION SELECT 'Brand#9')
SELECT configuration, environment, CASE WHEN model IN ('M8', 'M9') THEN 'baselines' ELSE 'complete' END AS part,
 model NOT IN ('M8', 'M9') AND dataset IN (SELECT dataset FROM sub) AS in_subset FROM meas""")
def split_subsets(spark, sf):
    every = meas(spark, sf).select("configuration", "environment", "dataset", "model")
    base, complete = K.split_models(every, BASE)
    names = K.subset_datasets(complete, "Brand#9").withColumn("hit", F.lit(True))
    marked = complete.join(names, "dataset", "left").withColumn("part", F.lit("complete"))
    return marked.unionByName(base.withColumns({"part": F.lit("baselines"), "hit": F.lit(None).cast("boolean")})).select(
        "configuration", "environment", "part", F.coalesce("hit", F.lit(False)).alias("in_subset")
    )


_SHORT = "split_part(environment, ' - ', 1)"


@query("budgets", f"""WITH {S.MEAS} SELECT {_SHORT} AS architecture, dataset, round(sum(train_running_time) + CAST(1e-9 AS DOUBLE), 6) AS seconds,
 greatest(CAST(trunc(round(sum(train_running_time) + CAST(1e-9 AS DOUBLE), 6)) AS BIGINT), 15) AS budget FROM meas WHERE model NOT IN ('M8', 'M9') GROUP BY 1, 2""")
def budgets(spark, sf):
    return K.budgets(K.split_models(meas(spark, sf), BASE)[1], digits=6)


_nn = " AND ".join(f"{p} IS NOT NULL" for p in PROPERTY_KEYS)


@query("env_stats", f"""WITH {S.MEAS} SELECT environment, round(sum(train_running_time) FILTER (model NOT IN ('M8', 'M9')) + CAST(1e-9 AS DOUBLE), 6) AS seconds,
 count(*) FILTER (model NOT IN ('M8', 'M9') AND {_nn}) AS n_complete, count(*) FILTER (model IN ('M8', 'M9') AND {_nn}) AS n_baselines FROM meas GROUP BY environment""")
def env_stats(spark, sf):
    base, complete = K.split_models(meas(spark, sf), BASE)
    return K.environment_statistics(complete, base, PROPERTY_KEYS, digits=6)


@query("drop_all_null_props", f"WITH {S.MEAS}, {S.cells()} SELECT {S.G}, property, count(value) AS n FROM cells WHERE group_count > 0 GROUP BY {S.G}, property")
def drop_null_props(spark, sf):
    counts = meas(spark, sf).groupBy(*GROUP_KEYS).agg(*[F.count(p).alias(p) for p in PROPERTY_KEYS])
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("n")) for p in PROPERTY_KEYS])
    return counts.select(*GROUP_KEYS, F.inline(entries)).filter("n > 0")


@query("sub_db", f"WITH {S.MEAS} SELECT {S.G}, model, n_results, {', '.join(p for p in PROPERTY_KEYS if p != 'recall')} FROM meas WHERE task = 'N'")
def sub_db(spark, sf):
    return sub_table(meas(spark, sf), PROPERTY_KEYS, task="N").drop("configuration")


@query("relevant_metrics", f"""WITH {S.MEAS}, {S.cells()}, t AS (SELECT dataset, task, property, any_value(pos) AS pos, any_value(weight) AS weight, any_value(grp) AS grp,
  any_value(independent) AS independent, count(value) AS n FROM cells GROUP BY dataset, task, property),
 d AS (SELECT *, sum(n) OVER (PARTITION BY dataset, property) AS nd FROM t),
 k AS (SELECT * FROM d WHERE n > 0 OR (independent AND nd > 0)),
 o AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY weight, pos) AS rn FROM k)
SELECT dataset, task, string_agg(property, ',' ORDER BY rn) AS metrics, arg_max(property, rn) FILTER (grp = 'Performance') AS y_axis,
 arg_max(property, rn) FILTER (grp = 'Resources') AS x_axis FROM o GROUP BY dataset, task HAVING count(*) >= 2""")
def relevant(spark, sf):
    return relevant_metrics(meas(spark, sf), PROPS).withColumn("metrics", F.array_join("metrics", ","))


# ---------------------------------------------------------------- names and formats

_KEYS = "CASE l_linenumber WHEN 1 THEN 'accuracy' WHEN 2 THEN 'train_power_draw' WHEN 3 THEN 'compound_index' WHEN 4 THEN 'resource_INDEX_index' WHEN 5 THEN l_returnflag ELSE 'f1' END"


@query("meta_lookup", f"""WITH {S.META}, k AS (SELECT {_KEYS} AS key FROM lineitem)
SELECT k.key, CASE WHEN contains(key, '_index') THEN concat(upper(substr(replace(key, '_index', ''), 1, 1)), lower(substr(replace(key, '_index', ''), 2)), ' Index')
 ELSE coalesce(meta.name, key) END AS title, count(*) AS n FROM k LEFT JOIN meta ON k.key = meta.property GROUP BY ALL""")
def meta_lookup(spark, sf):
    keys = table(spark, sf, "lineitem").groupBy(F.expr(_KEYS).alias("key")).agg(F.count("*").alias("n"))
    known = meta_frame(spark).select(F.col("property").alias("key"), "name")  # one row per configured property
    return keys.join(F.broadcast(known), "key", "left").select("key", N.title_of(F.col("key"), F.col("name")).alias("title"), "n")


_VARIANT = "CASE WHEN p_size % 4 = 0 THEN p_brand ELSE concat('v', p_size % 10, '_', p_size % 12, '___', p_brand) END"


@query("variant_parse", f"""WITH v AS (SELECT p_partkey, {_VARIANT} AS name FROM part)
SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^v(\\d)_(\\d)___(.*)') THEN CAST(regexp_extract(name, '^v(\\d)_(\\d)___(.*)', 1) AS INTEGER) END AS number,
 CASE WHEN regexp_matches(name, '^v(\\d)_(\\d)___(.*)') THEN CAST(regexp_extract(name, '^v(\\d)_(\\d)___(.*)', 2) AS INTEGER) END AS of_n,
 CASE WHEN regexp_matches(name, '^v(\\d)_(\\d)___(.*)') THEN regexp_extract(name, '^v(\\d)_(\\d)___(.*)', 3) ELSE name END AS base FROM v""")
def variant_parse(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, F.col("p_brand"))
        .otherwise(N.variant_name(F.col("p_brand"), F.col("p_size") % 10, F.col("p_size") % 12)).alias("name"),
    )
    number, of_n, base = N.parse_variant(F.col("name"))
    return named.select("p_partkey", "name", number.alias("number"), of_n.alias("of_n"), base.alias("base"))


_MEASURES = {"acctbal": ("c_acctbal", "byte"), "seconds": ("c_acctbal / 1000000", "seconds"), "number": ("c_acctbal * 3", "number")}


def _fmt_sql(v):
    return f"""CASE WHEN {v} IS NULL THEN 'N.A.' WHEN {v} < 1000 AND {v} >= 0.0001 THEN substr(printf('%7.6f', {v}), 1, 7)
 ELSE replace(replace(printf('%.2e', {v}), 'e+0', 'e+'), 'e-0', 'e-') END"""


@query("format_values", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_fmt_sql('l_extendedprice')} AS price, {_fmt_sql('l_tax')} AS tax,
 {_fmt_sql('(-l_quantity * 1000)')} AS negative, {_fmt_sql('(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount / 10000 END)')} AS small FROM lineitem""")
def format_values(spark, sf):
    small = F.when(F.col("l_linenumber") != 7, F.col("l_discount") / 10000)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.format_number(F.col("l_extendedprice")).alias("price"),
        U.format_number(F.col("l_tax")).alias("tax"), U.format_number(-F.col("l_quantity") * 1000).alias("negative"),
        U.format_number(small).alias("small"),
    )


def _step_sql(v):
    return f"(CASE WHEN abs({v}) > 0 THEN CAST(floor(round(log10(abs({v})), 9) / 3) AS INTEGER) ELSE 0 END)"


_PREF = "['q','r','y','z','a','f','p','n','µ','m','','k','M','G','T','P','E','Z','Y','R','Q']"


@query("unit_compact", f"""WITH v AS (SELECT c_custkey, c_acctbal AS bytes, c_acctbal / 1000000 AS seconds, c_acctbal * 3 AS number FROM customer),
 u AS (SELECT c_custkey, 'byte' AS unit, bytes AS value, {_step_sql('bytes')} AS step, 'B' AS symbol FROM v
  UNION ALL SELECT c_custkey, 'seconds', seconds, {_step_sql('seconds')}, 's' FROM v
  UNION ALL SELECT c_custkey, 'number', number, 0, '#' FROM v)
SELECT c_custkey, unit, round(value / pow(CAST(1000 AS DOUBLE), step) + CAST(1e-9 AS DOUBLE), 6) AS scaled, concat('[', {_PREF}[step + 11], symbol, ']') AS symbol FROM u""")
def unit_compact(spark, sf):
    customer = table(spark, sf, "customer")
    measures = {"byte": F.col("c_acctbal"), "seconds": F.col("c_acctbal") / 1000000, "number": F.col("c_acctbal") * 3}
    cells = F.array(*[
        F.struct(
            F.lit(u).alias("unit"), r6(U.scale_to(v, U.unit_step(v, u))).alias("scaled"),
            U.unit_symbol(U.unit_step(v, u), u).alias("symbol"),
        )
        for u, v in measures.items()
    ])
    return customer.select("c_custkey", F.inline(cells))


# ---------------------------------------------------------------- user actions on rated tables


@query("scatter", f"""WITH {S.SCORE_RATED}, xy AS (SELECT {S.G}, model, max(CASE WHEN property = 'train_power_draw' THEN index END) AS x,
  max(CASE WHEN property = 'recall' THEN index END) AS y FROM rated GROUP BY {S.G}, model)
SELECT environment, dataset, task, model, coalesce(x, 0) AS x, coalesce(y, 0) AS y, compound_index, compound_rating FROM score_rated JOIN xy USING ({S.G}, model)""")
def scatter(spark, sf):
    rated = rate(meas(spark, sf)).database
    return rated.select(
        "environment", "dataset", "task", "model", F.coalesce(idx("train_power_draw"), F.lit(0.0)).alias("x"),
        F.coalesce(idx("recall"), F.lit(0.0)).alias("y"), "compound_index", "compound_rating",
    )


@query("merge_subset", f"""WITH {S.RATED}, w AS (SELECT *, CASE WHEN task = 'A' AND property = 'accuracy' THEN CAST(0.5 AS DOUBLE) ELSE weight END AS w2 FROM rated)
SELECT configuration, environment, round(sum(w2 * index) / sum(CASE WHEN index IS NOT NULL THEN w2 END) + CAST(1e-12 AS DOUBLE), 9) AS compound_index FROM w GROUP BY ALL""")
def merge_subset(spark, sf):
    from gaugewright.meta import with_weights
    from gaugewright.operators.compound import add_scores
    from gaugewright.catalog.rating import shared_table
    cells = materialize(shared_table(spark, sf)[0])
    changed, _ = with_weights(PROPS, {"accuracy": 0.5})
    keep = ["configuration", "environment", "compound_index"]
    full = add_scores(cells, PROPS).select(*keep)
    part = add_scores(cells.filter("task = 'A'"), changed).select(*keep)
    return K.replace_part(full, part)


@query("option_lists", f"""WITH {S.RUNS} SELECT DISTINCT kind, value FROM (SELECT unnest([{{'kind': 'dataset', 'value': dataset}}, {{'kind': 'task', 'value': task}},
 {{'kind': 'environment', 'value': concat(architecture, ' - ', software)}}, {{'kind': 'model', 'value': model}}], recursive := true) FROM runs)""")
def option_lists(spark, sf):
    lists = F.array(*[
        F.struct(F.lit(k).alias("kind"), c.alias("value"))
        for k, c in (("dataset", F.col("dataset")), ("task", F.col("task")),
                     ("environment", F.concat_ws(" - ", "architecture", "software")), ("model", F.col("model")))
    ])
    return runs(spark, sf).select(F.inline(lists)).distinct()


def _card_top():
    return f"""tops AS (SELECT {S.G}, model, string_agg(shortname, ',' ORDER BY rn) AS top4 FROM (
  SELECT {S.G}, model, shortname, row_number() OVER (PARTITION BY {S.G}, model ORDER BY weight DESC, pos DESC) AS rn
  FROM rated JOIN (SELECT property AS p, shortname FROM meta) ON property = p WHERE index IS NOT NULL) WHERE rn <= 4 GROUP BY {S.G}, model)"""


def top4():
    """The four heaviest rated properties of a row; equal weights: later property first."""
    entries = F.array(*[
        F.when(F.col(idx(p.key)).isNotNull(), F.struct(F.lit(p.weight).alias("w"), F.lit(i).alias("pos"), F.lit(p.shortname).alias("name")))
        for i, p in enumerate(PROPS)
    ])
    ordered = F.slice(F.sort_array(F.filter(entries, lambda e: e.isNotNull()), asc=False), 1, 4)
    return F.array_join(F.transform(ordered, lambda e: e["name"]), ",")


@query("label_top4", f"WITH {S.RATED}, {_card_top()} SELECT * FROM tops")
def label_top4(spark, sf):
    from gaugewright.catalog.rating import shared_table
    return shared_table(spark, sf)[0].select(*ROW, top4().alias("top4"))


@query("model_card", f"""WITH {S.SCORE_RATED}, {_card_top()}, acc AS (SELECT {S.G}, model, max(CASE WHEN property = 'accuracy' THEN value END) AS accuracy FROM rated GROUP BY {S.G}, model)
SELECT concat(task, ' on ', dataset) AS task, model, environment, concat(printf('%5.3f', compound_index), ' (', substr('ABCDE', compound_rating + 1, 1), ')') AS final_rating,
 top4, {_fmt_sql('accuracy')} AS accuracy FROM score_rated JOIN tops USING ({S.G}, model) JOIN acc USING ({S.G}, model)""")
def model_card(spark, sf):
    rated = rate(meas(spark, sf)).database
    final = F.concat(F.format_string("%5.3f", "compound_index"), F.lit(" ("), letter(F.col("compound_rating")), F.lit(")"))
    return rated.select(
        F.concat_ws(" on ", "task", "dataset").alias("task"), "model", "environment", final.alias("final_rating"),
        top4().alias("top4"), U.format_number(F.col("accuracy")).alias("accuracy"),
    )
