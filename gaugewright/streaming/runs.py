"""Keeping the merged table current while run logs arrive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.operators.merge import RUN_KEYS, with_identity

BUCKETS = 64  # of the names seen so far


def partial_sums(runs: DataFrame, order: str = "log_name") -> DataFrame:
    """Counts, sums and first texts per configuration and environment: all that merging needs to know of the runs."""
    texts, numbers = [], []
    for field in runs.schema.fields:
        if field.name not in RUN_KEYS:
            (texts if field.dataType.typeName() == "string" else numbers).append(field.name)
    first = [
        F.min(F.when(F.col(t).isNotNull(), F.struct(F.col(order).alias("at"), F.col(t).alias("text")))).alias(t) for t in texts
    ]
    sums = [F.struct(F.sum(F.col(n).cast("double")).alias("sum"), F.count(n).alias("n")).alias(n) for n in numbers]
    return runs.groupBy(*RUN_KEYS).agg(F.count("*").alias("n_results"), *first, *sums)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Sums of sums; the same columns."""
    kinds = {f.name: f.dataType for f in partials.schema.fields if f.dataType.typeName() == "struct"}
    texts = [c for c, t in kinds.items() if "text" in t.fieldNames()]
    numbers = [c for c in kinds if c not in texts]
    return partials.groupBy(*RUN_KEYS).agg(
        F.sum("n_results").alias("n_results"), *[F.min(t).alias(t) for t in texts],
        *[F.struct(F.sum(f"{n}.sum").alias("sum"), F.sum(f"{n}.n").alias("n")).alias(n) for n in numbers],
    )


def bucket(key: str) -> Column:
    """The bucket of a run's name among those seen."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def start_merge(runs: DataFrame, table: str, checkpoint: str, key: str = "log_name"):
    """Merge a stream of runs into a table of partial sums, one part per micro-batch.

    A run whose name was seen before does not count again: the names of earlier batches are a table, not state, and lie
    in buckets by their hash; a batch reads only the buckets of its own names (at most ``BUCKETS`` numbers reach the
    driver). Runs without a name can't be recognised, so each of them counts. A repeated batch compares itself with the
    batches before it only and replaces its own parts, so that the sink is exactly-once.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        seen = _parts(spark, f"{table}/names", f"`{key}` {kind}, batch long, bucket int")
        rows = batch.filter(F.col(key).isNotNull())
        # Names and how often they come are counted first: only the rows of names that come again have to meet.
        named = rows.groupBy(key).agg(F.count("*").alias("_rows")).withColumn("bucket", bucket(key))
        if seen is not None:
            hit = [r[0] for r in named.select("bucket").distinct().collect()]
            known = seen.filter((F.col("batch") < number) & F.col("bucket").isin(hit)).select(key)
            named, rows = (x.join(known, key, "left_anti").select(*x.columns) for x in (named, rows))
        own = f"{table}/names/batch={number}"
        named.write.mode("overwrite").partitionBy("bucket").parquet(own)
        again = spark.read.schema(f"`{key}` {kind}, _rows long").parquet(own).filter("_rows > 1").select(key)
        if not again.isEmpty():
            twice = rows.join(again, key, "left_semi").select(*batch.columns).dropDuplicates([key])
            rows = rows.join(again, key, "left_anti").select(*batch.columns).unionByName(twice)
        fresh = rows.unionByName(batch.filter(F.col(key).isNull()))
        partial_sums(fresh, key).write.mode("overwrite").parquet(f"{table}/sums/batch={number}")

    return (
        runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def _parts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        found = reader.parquet(path)
        found.limit(0).collect()
        return found
    except Exception as error:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def _current(spark: SparkSession, table: str) -> tuple[DataFrame, int | None]:
    """Partial sums that count: the latest compacted version and the batches after it."""
    sums, base = _parts(spark, f"{table}/sums"), _parts(spark, f"{table}/base")
    if base is None:
        return sums.drop("batch"), None
    upto = base.agg(F.max("upto")).first()[0]
    return reduce(DataFrame.unionByName, [base.filter(F.col("upto") == upto).drop("upto"), sums.filter(F.col("batch") > upto).drop("batch")]), upto


def compact(spark: SparkSession, table: str) -> int:
    """Merge all parts so far into one new base version; returns the last batch in it.  Reads skip older parts."""
    last = _parts(spark, f"{table}/sums").agg(F.max("batch")).first()[0]
    merged, upto = _current(spark, table)
    if upto != last:
        merge_partials(merged).write.mode("overwrite").parquet(f"{table}/base/upto={last}")
    return last


def current_table(spark: SparkSession, table: str) -> DataFrame:
    """The merged runs as of now."""
    merged = merge_partials(_current(spark, table)[0])
    kinds = {f.name: f.dataType for f in merged.schema.fields if f.dataType.typeName() == "struct"}
    columns = [
        F.col(f"{c}.text").alias(c) if "text" in t.fieldNames() else F.try_divide(F.col(f"{c}.sum"), F.col(f"{c}.n")).alias(c)
        for c, t in kinds.items()
    ]
    return with_identity(merged.select(*RUN_KEYS, "n_results", *columns)).drop("architecture", "software")
