"""Boundaries that stay current while measurements arrive in batches.

The kept table holds, below one path,

* ``rows/batch=b/slot=s``: the measurements, in slots by the hash of their group,
* ``references/batch=b``: the best value of every property per group of the batch,
* ``histogram/batch=b``: changes of the number of indices per property and bucket,
* ``values/batch=b/part=p``: changes of the number of indices per property and value, in parts by bucket.

A batch changes the index of an older row only if it brings a better value (or the first one) for the row's group. The rows
of such groups are read from their slots, their old indices are taken off the counts and the new ones added; no other
older row is read. Quantiles are exact: ranks are found in the summed histogram, and the few parts that hold a wanted
rank are read.

Every row of a batch counts, so a row must come once. Batches are written one after another, with growing numbers; one that
broke off is written again under its number (as a stream's foreachBatch does) and replaces its own files. Missing keys form groups, missing values follow the rules of
the indices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugewright.functions.scalars import quoted
from gaugewright.meta import GROUP_KEYS, QUANTILES
from gaugewright.operators.bounds import rounded
from gaugewright.operators.index import add_indices, best_references, idx, long_cells
from gaugewright.operators.joins import join_groups
from gaugewright.operators.quantiles import BUCKETS_PER_OCTAVE, pick_positions, quantile_positions, value_bucket
from gaugewright.session import materialize

SLOTS = 256  # of the groups
PARTS_PER_OCTAVE = 16  # indices have nine digits, so at most 31 octaves
HISTOGRAM = StructType().add("property", "string").add("_b", "long").add("_bc", "long")
VALUES = StructType().add("property", "string").add("_v", "double").add("_c", "long").add("_b", "long").add("part", "long")


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table of all batches with their number; empty if there is none yet."""
    schema = StructType(schema.fields[:]).add("batch", "long")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _slot(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def _part() -> Column:
    return F.floor(F.col("_b") / (BUCKETS_PER_OCTAVE // PARTS_PER_OCTAVE)).cast("long").alias("part")


def _best(references: DataFrame, properties, keys) -> DataFrame:
    """One reference per group from those of several batches."""
    return references.groupBy(*keys).agg(*[
        F.expr(f"{'max' if p.maximize else 'min'}({quoted(p.key + '__ref')}) AS {quoted(p.key + '__ref')}") for p in properties
    ])


def _index_counts(rows: DataFrame, references: DataFrame, properties, keys, sign: int) -> DataFrame:
    cells = long_cells(add_indices(rows, references, properties, keys), properties, [], ("index",))
    return cells.filter("index IS NOT NULL").groupBy("property", F.col("index").alias("_v")).agg((F.count("*") * sign).alias("_c"))


def older_rows(rows: DataFrame, batch: int, changed: DataFrame, keys) -> DataFrame:
    """The rows of earlier batches in the changed groups, read from these groups' slots only.

    At most ``SLOTS`` numbers reach the driver.
    """
    slots = [r[0] for r in changed.select(_slot(keys)).distinct().collect()]
    near = rows.filter((F.col("batch") < batch) & F.col("slot").isin(slots))
    return join_groups(near, changed.select(*keys), keys, "left_semi").drop("batch", "slot")


def add_batch(df: DataFrame, path: str, batch: int, properties, keys=GROUP_KEYS) -> None:
    """Adds one batch of measurements to the kept table."""
    spark, keys = df.sparkSession, list(keys)
    columns = [p.key for p in properties]
    slim = df.select(*keys, *columns, _slot(keys).alias("slot"))
    slim.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/rows/batch={batch}")
    rows = _stored(spark, f"{path}/rows", slim.schema)
    new = rows.filter(F.col("batch") == batch).drop("batch", "slot")
    own = materialize(best_references(new, properties, keys))

    # groups of this batch that older batches know, with their references before and after it
    known = _stored(spark, f"{path}/references", own.schema).filter(F.col("batch") < batch).drop("batch")
    before = materialize(_best(join_groups(known, own.select(*keys), keys, "left_semi"), properties, keys))
    after = materialize(_best(before.unionByName(own), properties, keys))
    was = before.withColumnsRenamed({f"{c}__ref": f"{c}__was" for c in columns})
    moved = reduce(Column.__or__, [~F.col(f"{c}__ref").eqNullSafe(F.col(f"{c}__was")) for c in columns])
    changed = materialize(join_groups(after, was, keys, "inner").filter(moved).select(*keys))
    old = older_rows(rows, batch, changed, keys)
    changes = [
        _index_counts(new, after, properties, keys, 1),
        _index_counts(old, before, properties, keys, -1), _index_counts(old, after, properties, keys, 1),
    ]
    net = reduce(DataFrame.unionByName, changes).groupBy("property", "_v").agg(F.sum("_c").alias("_c")).filter("_c <> 0")
    bucketed = materialize(net.withColumn("_b", F.expr(value_bucket("_v"))))
    bucketed.select("*", _part()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/values/batch={batch}")
    histogram = bucketed.groupBy("property", "_b").agg(F.sum("_c").alias("_bc")).filter("_bc <> 0")
    histogram.write.mode("overwrite").parquet(f"{path}/histogram/batch={batch}")
    own.write.mode("overwrite").parquet(f"{path}/references/batch={batch}")  # last: they make the batch count


def _parts_of(hit: DataFrame) -> list[int]:
    """Parts that hold the buckets: at most two per property and quantile."""
    return [r[0] for r in hit.select(_part()).distinct().collect()]


def kept_boundaries(spark: SparkSession, path: str, quantiles=QUANTILES) -> DataFrame:
    """The boundaries ``(property, bounds)`` of all batches that were written to the end; no rows without any."""
    last = _stored(spark, f"{path}/references", StructType()).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    histogram = _stored(spark, f"{path}/histogram", HISTOGRAM).filter(F.col("batch") <= last).groupBy("property", "_b").agg(F.sum("_bc").alias("_bc"))

    def counted(hit: DataFrame) -> DataFrame:
        values = _stored(spark, f"{path}/values", VALUES).filter((F.col("batch") <= last) & F.col("part").isin(_parts_of(hit)))
        return values.groupBy("property", "_b", "_v").agg(F.sum("_c").alias("_c")).filter("_c <> 0")

    found = pick_positions(materialize(histogram.filter("_bc <> 0")), counted, ["property"], quantile_positions(quantiles), "bounds")
    return found.select("property", rounded("bounds").alias("bounds"))
