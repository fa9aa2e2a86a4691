"""Preparing tabular data: one-hot columns, label codes, imputation, splits, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.names import variant_name
from gaugewright.operators.quantiles import exact_positions, exact_quantiles
from gaugewright.operators.ranking import ordered_rank

TEST_SHARE = 0.25


def one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """Each categorical column becomes one 0/1 column per named category; any other value is 0 in all of them."""
    hot = [
        F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0)).alias(f"{c}_{value}")
        for c, values in categories.items() for value in values
    ]
    return df.select(*[c for c in df.columns if c not in categories], *hot)


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each categorical column becomes its place among its sorted distinct values, -1 if missing.

    The place is the position of the one in a one-hot vector, for columns with any number of categories: codes are
    a table that is joined, not a list on the driver.
    """
    for c in columns:
        codes = ordered_rank(df.select(c).filter(F.col(c).isNotNull()).distinct(), [], [c]).select(c, F.col("rank").alias("_code"))
        df = df.join(codes, c, "left").withColumn(c, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_code")
    return df


def factorize(df: DataFrame, label: str, order: str, out: str = "code") -> DataFrame:
    """Label codes 0, 1, ... by first appearance in ``order``; a missing label has code -1."""
    firsts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_first"))
    codes = ordered_rank(firsts, [], ["_first"]).select(label, F.col("rank").cast("int").alias(out))
    return df.join(codes, label, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps take the median of the column over all rows; the medians are one number per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    medians = exact_quantiles(df.select(F.inline(cells)), ["column"], "v", [0.5], "m")
    found = {r["column"]: r["m"][0] for r in medians.collect()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c])) for c in columns if c in found})


def split_hash(row_id: Column, seed: int) -> Column:
    """52 bits of the MD5 of id and seed: the same order in every engine and for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(f"-{seed}"))), 1, 13), 16, 10).cast("double")


def train_test_split(df: DataFrame, row_id: str, seed: int = 42, share: float = TEST_SHARE) -> DataFrame:
    """Mark the ``ceil(share * n)`` rows with the smallest hash as test rows."""
    hashed = df.withColumn("_h", split_hash(F.col(row_id), seed))
    # hashes are uniform, so equal-width buckets of 2**32 are balanced
    limit = exact_positions(
        hashed, [], "_h", [lambda n: f"ceil({n} * {float(share)!r}D) - 1"], "_limit", lambda v: f"CAST(floor({v} / {2.0**32!r}D) AS BIGINT)"
    )
    threshold = limit.select(F.col("_limit")[0]).scalar()
    return hashed.withColumn("is_test", F.col("_h") <= threshold).drop("_h")


def feature_variants(features: DataFrame, k: int, seed: int = 430286, key: str = "dataset") -> DataFrame:
    """Shuffled k-fold over the feature names of a data set; variant j keeps fold j.

    The window holds the column names of one data set, not its rows.
    """
    shuffled = Window.partitionBy(key).orderBy(F.md5(F.concat("feature", F.lit(f"-{seed}"))), "feature")
    fold = features.withColumn("variant", F.ntile(k).over(shuffled) - 1)
    return fold.withColumn("variant_name", variant_name(F.col(key), F.col("variant"), F.lit(k)))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns only lose their mean."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]
    ).first()

    def scaled(c):
        deviation = stats[f"{c}__s"] or 1.0
        return (F.col(c) - (stats[f"{c}__m"] or 0.0)) / deviation

    return df.withColumns({c: scaled(c) for c in columns})
