"""Pooled feature-label pairs of repeated small samples of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups
from gaugewright.session import materialize

# Rows, features and classes of one sample; samples per data set (10 rounds of 16).
ROWS, FEATURES, CLASSES = 256, 16, 3
DRAWS = 10 * 16
PRIME = 2**31 - 1


def mark(text: Column) -> Column:
    """A number below PRIME from the MD5 of a text: computed once per row."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % PRIME


def order_in(number: Column, draw: Column) -> Column:
    """Place of a marked row in a draw: another line modulo a prime for every draw, in whole numbers below 2**62."""
    step = (draw.cast("long") * 104729 + 7919) * 15485863 % PRIME + 1
    return (number * step + draw.cast("long") * 32452843) % PRIME


def smallest(frame: DataFrame, keys: list[str], order, tie: str, n: int) -> DataFrame:
    """The n first rows per key; the rank limit keeps no more than n per partition and key before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(order, tie)
    return frame.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def drawn_rows(df: DataFrame, row_id: str, key: str, draws: int, rows: int) -> DataFrame:
    """Per data set and draw the ``rows`` rows with the smallest places: (key, draw, _id).

    A row is copied only into the draws in which its place lies below a threshold that about ``2 rows`` reach; a
    data set and draw that came out short is drawn again from all its rows.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_size"))
    share = F.least(F.lit(1.0), (2.0 * rows + 64) / F.col("_size"))
    marked = join_groups(df.select(key, F.col(row_id).alias("_id"), mark(F.col(row_id).cast("string")).alias("_mark")), sizes, [key])
    every = F.sequence(F.lit(0), F.lit(draws - 1))

    def placed(frame: DataFrame, wanted: Column) -> DataFrame:
        spread = frame.select(key, "_id", "_mark", "_size", F.explode(wanted).alias("draw"))
        return spread.withColumn("_place", order_in(F.col("_mark"), F.col("draw")))

    near = F.filter(every, lambda d: order_in(F.col("_mark"), d) < share * PRIME)
    first = materialize(smallest(placed(marked, near), [key, "draw"], "_place", "_id", rows))
    got = first.groupBy(key, "draw").agg(F.count("*").alias("_got"), F.max("_size").alias("_size"))
    grid = sizes.select(key, "_size", F.explode(every).alias("draw")).select(key, "_size", "draw")
    short = join_groups(grid, got.drop("_size"), [key, "draw"]).filter(
        F.coalesce("_got", F.lit(0)) < F.least(F.col("_size"), F.lit(rows))
    ).groupBy(key).agg(F.collect_list("draw").alias("_short"))  # at most ``draws`` numbers per data set
    short = materialize(short)
    if short.isEmpty():
        return first.select(key, "draw", "_id")
    again = join_groups(marked, short, [key], "inner")
    more = smallest(placed(again, F.col("_short")), [key, "draw"], "_place", "_id", rows)
    missing = short.select(key, F.explode("_short").alias("draw"))
    kept = join_groups(first, missing, [key, "draw"], "left_anti")
    return kept.select(key, "draw", "_id").union(more.select(key, "draw", "_id"))


def pair_pooling(
    df: DataFrame, row_id: str, features: list[str], label: str, key: str = "dataset",
    draws: int = DRAWS, rows: int = ROWS, n_features: int = FEATURES, n_classes: int = CLASSES,
) -> DataFrame:
    """Mean of value, class membership and their product over the sampled (feature, class) pairs.

    A sample takes the rows, features and classes with the smallest places in the order of its draw.
    """
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    values = df.select(key, F.col(row_id).alias("_id"), F.col(label).alias("_label"), cells.alias("cells"))
    sample = join_groups(drawn_rows(df, row_id, key, draws, rows), values, [key, "_id"])
    if len(features) > n_features:
        names = F.array(*[F.lit(f) for f in features])
        placed = F.transform(names, lambda f: F.named_struct(F.lit("h"), order_in(mark(f), F.col("draw")), F.lit("f"), f))
        picks = df.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")).select(
            "draw", F.slice(F.array_sort(placed), 1, n_features)["f"].alias("_picked")
        )
        sample = sample.join(F.broadcast(picks), "draw").withColumn(  # one row per draw
            "cells", F.filter("cells", lambda c: F.array_contains("_picked", c["feature"]))
        )
    # per feature and class: sums over the sampled rows of that class; means follow with the sample size
    sums = sample.select(key, "draw", "_label", F.inline("cells")).groupBy(key, "draw", "feature", "_label").agg(
        F.sum("x").alias("sx"), F.count("*").alias("c")
    )
    per_feature = sums.groupBy(key, "draw", "feature").agg(F.sum("sx").alias("total"), F.sum("c").alias("n"))
    all_classes = df.select(key, F.col(label).alias("_label")).distinct().select(key, "_label", draw)
    order = order_in(mark(F.col("_label").cast("string")), F.col("draw"))
    classes = smallest(all_classes, [key, "draw"], order, "_label", n_classes)
    pairs = join_groups(join_groups(per_feature, classes, [key, "draw"], "inner"), sums, [key, "draw", "feature", "_label"])
    per_draw = pairs.groupBy(key, "draw").agg(
        F.avg(F.col("total") / F.col("n")).alias("x"), F.avg(F.coalesce(F.col("c") / F.col("n"), F.lit(0.0))).alias("y"),
        F.avg(F.coalesce(F.col("sx") / F.col("n"), F.lit(0.0))).alias("xy"),
    )
    return per_draw.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("x", "y", "xy")])
