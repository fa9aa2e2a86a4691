"""Energy of runs from power samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: milliwatt seconds per kilowatt hour.
MWS_PER_KWH = 3.6e9


def energy_columns(ts: str, power: str, cores=(), others=()):
    """Aggregates of one run or window: duration, energy, summed core load, means, number of samples."""
    span = F.max(ts) - F.min(ts)
    seconds = span.cast("interval second").cast("decimal(20,6)").cast("double")
    columns = [
        seconds.alias("duration"), (F.avg(power) * seconds / MWS_PER_KWH).alias("energy_consumed"),
        F.count("*").alias("no_meas"),
    ]
    if cores:
        columns.append(sum((F.avg(c) for c in cores[1:]), F.avg(cores[0])).alias("total_cpu"))
    return columns + [F.avg(o).alias(o) for o in others]


def run_energy(samples: DataFrame, run: str, ts: str, power: str, cores=(), others=()) -> DataFrame:
    return samples.groupBy(run).agg(*energy_columns(ts, power, cores, others))
