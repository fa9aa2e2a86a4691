"""Results of hyperparameter searches.  A search has at most ``n_iter`` settings (50 in the fixed setup)."""

from __future__ import annotations

from hashlib import md5
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH = ("dataset", "method")


def _score():
    """Failed fits (NaN or NULL) rank as 0."""
    score = F.col("mean_test_score")
    return F.coalesce(F.when(~F.isnan(score), score), F.lit(0.0))


def average_rank(df: DataFrame, keys=SEARCH) -> DataFrame:
    """Descending rank, mean over equal scores, cut to an integer."""
    scored = df.withColumn("_s", _score())
    by_score = Window.partitionBy(*keys).orderBy(F.desc("_s"))
    ties = Window.partitionBy(*keys, "_s")
    rank = F.rank().over(by_score) + (F.count("*").over(ties) - 1) / 2
    return scored.withColumn("rank_test_score", F.floor(rank).cast("int")).drop("_s")


def min_rank(df: DataFrame, keys=SEARCH) -> DataFrame:
    scored = df.withColumn("_s", _score())
    return scored.withColumn(
        "rank_test_score", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_s")))
    ).drop("_s")


def best_params(df: DataFrame, keys=SEARCH) -> DataFrame:
    """Setting with the first smallest rank."""
    return df.filter("rank_test_score IS NOT NULL").groupBy(*keys).agg(
        F.min_by("params", F.struct("rank_test_score", "pos")).alias("params")
    )


def sensitivity(df: DataFrame, keys=SEARCH) -> DataFrame:
    """Population deviation of the mean scores; undefined if any fit failed."""
    score = F.col("mean_test_score")
    failed = F.count_if(F.isnan(score) | score.isNull())
    return df.groupBy(*keys).agg(F.when(failed == 0, F.stddev_pop(score)).alias("sensitivity"))


def draw_settings(grid: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """At most ``n_iter`` settings of a grid (name -> values) without repetition, in MD5 order of their text."""
    settings = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return sorted(settings, key=lambda s: md5(f"{s}-{seed}".encode()).hexdigest())[:n_iter]
