"""Queries: parsers of run files, merged logs and search results, over texts made from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.catalog.base import query, r6
from gaugewright.sources import logs as L
from gaugewright.sources.files import parse_search_results
from gaugewright.sources.views import table

# Spark and DuckDB name a run the same way; a repeated line item is one run.
_NAME = "concat_ws('_', 'train', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
_LINES = f"lines AS (SELECT DISTINCT {_NAME} AS directory_name, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus, l_returnflag FROM lineitem)"


def lines(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(F.expr(_NAME).alias("directory_name"), "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag").distinct()


def _emissions():
    """CSV with quoted commas before the figures; the second row only for some runs, without a figure for others."""
    second = F.when(F.col("l_linestatus") == "O", F.concat(F.lit('\n,'), "l_discount", F.lit(',"a,b",'), F.when(F.col("l_linenumber") != 2, F.col("l_tax").cast("string")).otherwise("")))
    return F.concat(
        F.lit('cpu,duration,"odd, name",energy_consumed\r\n"Intel, ""i7""",'), "l_quantity", F.lit(",x,"), "l_tax", F.coalesce(second, F.lit("")), F.lit("\n")
    )


def _requirements():
    return F.concat(F.lit("numpy==1."), "l_linenumber", F.lit("\r\nscikit-learn==1."), F.col("l_suppkey") % 5, F.lit(".0\n"))


def _results():
    text = F.to_json(F.struct(F.struct((1 - F.col("l_discount")).alias("accuracy")).alias("metrics")))
    return F.when(F.col("l_linenumber") == 5, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


_SECOND = "l_linestatus = 'O'"
_ENERGY = "CASE WHEN l_linestatus = 'O' AND l_linenumber <> 2 THEN l_tax END"


@query("emissions_scan", f"""WITH {_LINES} SELECT directory_name, 1 + CAST({_SECOND} AS INTEGER) AS n, l_quantity AS train_seconds, l_tax AS train_kwh,
 CASE WHEN {_SECOND} THEN l_discount END AS seconds, {_ENERGY} AS kwh FROM lines""")
def emissions_scan(spark, sf):
    parsed = lines(spark, sf).select("directory_name", L.parse_emissions(_emissions()).alias("e"))
    first, second = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    return parsed.select(
        "directory_name", F.size("e").alias("n"), first["duration"].alias("train_seconds"), first["energy_consumed"].alias("train_kwh"),
        second["duration"].alias("seconds"), second["energy_consumed"].alias("kwh"),
    )


@query("requirements_scan", f"""WITH {_LINES} SELECT directory_name, concat('numpy==1.', l_linenumber) AS first, concat('scikit-learn==1.', l_suppkey % 5, '.0') AS last, 2 AS n FROM lines""")
def requirements_scan(spark, sf):
    parsed = lines(spark, sf).select("directory_name", L.parse_requirements(_requirements()).alias("r"))
    return parsed.select("directory_name", F.get("r", F.lit(0)).alias("first"), F.get("r", F.size("r") - 1).alias("last"), F.size("r").alias("n"))


@query("run_directory_scan", f"""WITH {_LINES} SELECT directory_name, CASE WHEN l_linenumber <> 6 THEN l_returnflag END AS ds, CASE WHEN l_linenumber <> 5 THEN round(1 - l_discount + CAST(1e-9 AS DOUBLE), 6) END AS accuracy,
 concat('scikit-learn==1.', l_suppkey % 5, '.0') AS last, l_quantity AS train_seconds, {_ENERGY} AS kwh FROM lines""")
def run_directory_scan(spark, sf):
    """Files of every run side by side: a missing configuration and a broken result leave NULL."""
    config = F.when(F.col("l_linenumber") != 6, F.to_json(F.struct(F.col("l_returnflag").alias("ds"))))
    parts = {"config.json": config, "results.json": _results(), "emissions.csv": _emissions(), "requirements.txt": _requirements(), "model.pkl": F.lit("x")}
    cells = F.array(*[F.struct(F.lit(n).alias("file"), c.alias("value")) for n, c in parts.items()])
    files = lines(spark, sf).select("directory_name", F.inline(cells)).filter("value IS NOT NULL")
    runs = L.assemble_runs(files)
    return runs.select(
        "directory_name", "config.ds", r6("results.metrics.accuracy").alias("accuracy"), F.get("requirements", F.lit(1)).alias("last"),
        F.get("emissions", F.lit(0))["duration"].alias("train_seconds"), F.get("emissions", F.lit(1))["energy_consumed"].alias("kwh"),
    )


def merged_texts(spark, sf):
    """Merged logs with emissions as rows or as columns; every third one is cut off."""
    both = [("duration", "l_quantity", "l_discount"), ("energy_consumed", "l_tax", "l_tax")]
    rows = F.array(*[F.struct(*[F.col(pair[i]).alias(pair[0]) for pair in both]) for i in (1, 2)])
    columns = F.struct(*[F.struct(F.col(b).alias("1"), F.col(a).alias("0")).alias(n) for n, a, b in both])

    def text(emissions):
        return F.to_json(F.struct("directory_name", F.struct(F.col("l_returnflag").alias("ds")).alias("config"), emissions.alias("emissions")))

    whole = F.when(F.col("l_linenumber") % 3 == 0, text(rows)).otherwise(text(columns))
    cut = F.substr(whole, F.lit(1), F.length(whole) - 2)
    indented = F.replace(whole, F.lit(',"'), F.lit(',\n    "'))
    return lines(spark, sf).select(F.when(F.col("l_linenumber") % 3 == 2, cut).otherwise(indented).alias("value"))


@query("merged_log_scan", f"""WITH {_LINES} SELECT directory_name, l_returnflag AS ds, l_quantity AS train_seconds, l_discount AS seconds, l_tax AS kwh FROM lines WHERE l_linenumber % 3 <> 2""")
def merged_log_scan(spark, sf):
    good, _ = L.parse_merged_logs(merged_texts(spark, sf))
    first, second = F.get("emissions", F.lit(0)), F.get("emissions", F.lit(1))
    return good.select("directory_name", "config.ds", first["duration"].alias("train_seconds"), second["duration"].alias("seconds"), second["energy_consumed"].alias("kwh"))


@query("merged_log_rejects", f"""WITH {_LINES} SELECT l_returnflag AS ds, count(*) AS n FROM lines WHERE l_linenumber % 3 = 2 GROUP BY l_returnflag""")
def merged_log_rejects(spark, sf):
    _, bad = L.parse_merged_logs(merged_texts(spark, sf))
    return bad.groupBy(F.regexp_extract("_corrupt", r'"ds":"(.)"', 1).alias("ds")).agg(F.count("*").alias("n"))


@query("search_scan", """WITH s AS (SELECT p_brand, l_returnflag AS method, l_linenumber - 1 AS pos, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 k AS (SELECT p_brand, method, max(pos) AS last FROM s GROUP BY ALL)
SELECT concat('v0_2___', p_brand) AS dataset, method, CAST(row_number() OVER (PARTITION BY p_brand, method ORDER BY pos) - 1 AS INTEGER) AS pos, CAST(pos AS VARCHAR) AS setting,
 CASE WHEN pos = 2 THEN 'NaN'::DOUBLE WHEN row_number() OVER (PARTITION BY p_brand, method ORDER BY pos) <= 5 THEN CAST(n AS DOUBLE) END AS mean_test_score FROM s JOIN k USING (p_brand, method)""")
def search_scan(spark, sf):
    """Search files with a NaN score and fewer scores than settings."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    tried = line.groupBy("p_brand", F.col("l_returnflag").alias("method"), (F.col("l_linenumber") - 1).alias("pos")).agg(F.count("*").alias("n"))
    cells = tried.groupBy("p_brand", "method").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("t"))  # one per setting
    params = F.array_join(F.transform("t", lambda x: F.concat(F.lit('{"C": "'), x["pos"], F.lit('"}'))), ", ")
    scores = F.array_join(F.transform(F.slice("t", 1, 5), lambda x: F.when(x["pos"] == 2, "NaN").otherwise(x["n"].cast("string"))), ", ")
    texts = cells.select(
        F.concat(F.lit("hyperparameters__v0_2___"), "p_brand", F.lit("__"), "method", F.lit(".json")).alias("file"),
        F.concat(F.lit('{"params": ['), params, F.lit('],\n "mean_test_score": ['), scores, F.lit("]}")).alias("value"),
    )
    found = parse_search_results(texts)
    return found.select("dataset", "method", "pos", F.col("params")["C"].alias("setting"), "mean_test_score")
