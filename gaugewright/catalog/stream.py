"""Queries: the two incremental jobs, run over all available files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugewright.catalog import sqltext as S
from gaugewright.catalog.base import query, r6
from gaugewright.meta import PROPERTY_KEYS
from gaugewright.session import shared_dir
from gaugewright.sources.views import run_view, table
from gaugewright.streaming.energy import start_energy, windowed_energy
from gaugewright.streaming.runs import current_table, start_merge

DELAY = "10 minutes"


def _places(spark):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


def _stream(spark, sf, name):
    """The files of a table as a stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


_SIX = ", ".join(f"round({p} + CAST(1e-9 AS DOUBLE), 6) AS {p}" for p in PROPERTY_KEYS)
# line items may repeat a name; with the price no name stands for two measurements
_UNIQUE = S.MEAS.replace("l_suppkey) AS log_name", "l_suppkey,'_',CAST(round(l_extendedprice * 100) AS BIGINT)) AS log_name")


@query("stream_merge_runs", f"WITH {_UNIQUE} SELECT configuration, environment, n_results, log_name, {_SIX} FROM meas")
def stream_merge(spark, sf):
    place, checkpoint = _places(spark)
    runs = run_view(_stream(spark, sf, "lineitem"), table(spark, sf, "part"))
    named = runs.withColumn("log_name", F.concat_ws("_", "log_name", F.round(F.col("train_power_draw") * 5000).cast("long")))
    start_merge(named, place, checkpoint).awaitTermination()
    return current_table(spark, place).select(
        "configuration", "environment", "n_results", "log_name", *[r6(F.round(p, 9)).alias(p) for p in PROPERTY_KEYS]
    )


def _energy(spark, sf, window):
    place, checkpoint = _places(spark)
    samples = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    energy = windowed_energy(samples, "user_id", "ts", "value", window, DELAY)
    start_energy(energy, place, checkpoint).awaitTermination()
    found = spark.read.schema(energy.schema).parquet(place)
    return found.select(
        "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), r6("duration").alias("duration"),
        r6(F.col("energy_consumed") * 1e6).alias("energy_mwh"), "no_meas",
    )


_SECONDS = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"
_COLUMNS = f"round({_SECONDS} + CAST(1e-9 AS DOUBLE), 6) AS duration, round(avg(value) * {_SECONDS} / 3.6e9 * 1e6 + CAST(1e-9 AS DOUBLE), 6) AS energy_mwh, count(*) AS no_meas"
# windows are written once the watermark (latest sample minus the delay) has reached their end
_MARK = "mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events)"


@query("stream_energy_tumbling", f"""WITH {_MARK}, w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events)
SELECT user_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, {_COLUMNS} FROM w GROUP BY user_id, window_start HAVING window_start + INTERVAL 1 HOUR <= (SELECT wm FROM mark)""")
def tumbling(spark, sf):
    return _energy(spark, sf, F.window("ts", "1 hour"))


@query("stream_energy_sliding", f"""WITH {_MARK}, w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS window_start FROM events, range(2) AS t(i))
SELECT user_id, window_start, window_start + INTERVAL 2 HOUR AS window_end, {_COLUMNS} FROM w GROUP BY user_id, window_start HAVING window_start + INTERVAL 2 HOUR <= (SELECT wm FROM mark)""")
def sliding(spark, sf):
    return _energy(spark, sf, F.window("ts", "2 hours", "1 hour"))


@query("stream_energy_session", f"""WITH {_MARK}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, {_COLUMNS} FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT wm FROM mark)""")
def sessions(spark, sf):
    return _energy(spark, sf, F.session_window("ts", "6 hours"))
