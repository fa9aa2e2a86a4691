"""Statistical description of tabular data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups

# Names of the results.
MOMENTS = ("mean", "variance", "skewness", "kurtosis", "min", "max")
STATISTICAL = (
    "n_instances", "n_predictors", "n_classes", "class_freq_mean", "class_freq_std", "n_num", "n_onehot",
    "num_onehot_ratio", "onehot_bal_mean", "onehot_bal_std", "onehot_bal_max", "onehot_bal_min",
    *[f"{m}_{a}" for m in MOMENTS for a in ("mean", "std")],
)


def feature_moments(df: DataFrame, features: list[str], key: str = "dataset") -> DataFrame:
    """Moments of every feature per data set; a feature is two-valued if its ends differ and nothing lies between."""
    ends = df.groupBy(key).agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])

    def between(c: str):
        return F.when((F.col(c) > F.col(f"{c}__lo")) & (F.col(c) < F.col(f"{c}__hi")), True)

    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), between(f).alias("between")) for f in features
    ])
    varied = F.max("v") > F.min("v")  # merged means of a constant can differ in the last bit, which gives it a shape
    return join_groups(df.select(key, *features), ends, [key]).select(key, F.inline(cells)).groupBy(key, "feature").agg(
        F.count("*").alias("n"), (varied & (F.count("between") == 0)).alias("two_valued"),
        (F.count_if(F.col("v") != 0) / F.count("*")).alias("balance"),
        F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.when(varied, F.skewness("v")).alias("skewness"),
        F.when(varied, F.kurtosis("v")).alias("kurtosis"), F.min("v").alias("min"), F.max("v").alias("max"),
    )


def statistical(df: DataFrame, features: list[str], label: str, key: str = "dataset") -> DataFrame:
    """24 numbers per data set.  Features with exactly two values are described by their balance, all others
    by mean and population deviation of their moments."""
    moments = feature_moments(df, features, key)
    onehot = F.coalesce("two_valued", F.lit(False))
    balance = F.when(onehot, F.col("balance"))
    over_features = moments.groupBy(key).agg(
        F.max("n").alias("n_instances"), F.count("*").alias("n_predictors"),
        F.count_if(~onehot).alias("n_num"), F.count_if(onehot).alias("n_onehot"),
        F.avg(balance).alias("onehot_bal_mean"), F.stddev_pop(balance).alias("onehot_bal_std"),
        F.max(balance).alias("onehot_bal_max"), F.min(balance).alias("onehot_bal_min"),
        *[
            F.coalesce(agg(F.when(~onehot, F.col(m))), F.lit(0.0)).alias(f"{m}_{name}")
            for m in MOMENTS for name, agg in (("mean", F.avg), ("std", F.stddev_pop))
        ],
    )
    classes = df.groupBy(key, label).agg(F.count("*").alias("_c")).groupBy(key).agg(
        F.count("*").alias("n_classes"), F.avg("_c").alias("class_freq_mean"), F.stddev_pop("_c").alias("class_freq_std")
    )
    ratio = F.coalesce(F.try_divide(F.col("n_num") / F.col("n_predictors"), F.col("n_onehot")), F.lit(1.0))
    return join_groups(over_features, classes, [key]).withColumn("num_onehot_ratio", ratio).select(key, *STATISTICAL)


def profile(df: DataFrame, label: str, n_features, key: str = "dataset") -> DataFrame:
    """Rows, share of the training part, classes, features and the number of feature subsets to form."""
    counted = df.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(label).alias("n_classes"), n_features.alias("n_features")
    )
    train = F.col("n") - F.ceil(F.col("n") * 0.25)
    subsets = (
        F.when(F.col("n_features") > 100, 5).when(F.col("n_features") > 60, 3).when(F.col("n_features") > 40, 2)
    )
    return counted.withColumns({"train_share": train / F.col("n"), "subsets": subsets}).orderBy("n", key)
