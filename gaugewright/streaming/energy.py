"""Energy per run and time window from a stream of power samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.energy import energy_columns


def windowed_energy(samples: DataFrame, run: str, ts: str, power: str, window, delay: str) -> DataFrame:
    """Energy, duration and sample count per run and window; samples behind the watermark are dropped.

    ``window`` is a time window column such as ``F.window(ts, ...)`` or ``F.session_window(ts, gap)``.
    """
    return (
        samples.withWatermark(ts, delay).groupBy(run, window.alias("window"))
        .agg(*energy_columns(ts, power), F.avg(power).alias("mean_power"))
        .select(run, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "duration", "energy_consumed", "no_meas", "mean_power")
    )


def start_energy(energy: DataFrame, table: str, checkpoint: str):
    """Append every window to a Parquet table once the watermark has passed its end."""
    return (
        energy.writeStream.format("parquet").outputMode("append").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
