"""Tables in and out: databases, search results, meta-features, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH_FILE = r"hyperparameters__(.*)__([^_]+)\.json$"


def load_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_database(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by data set, so that one data set can be read or replaced alone."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def densify(sparse: DataFrame, row_keys: list[str], columns: list[str], name="property", value="value") -> DataFrame:
    """Sparse (row, column, text) entries to a wide table: columns become numbers where they can."""
    wide = sparse.groupBy(*row_keys).pivot(name, columns).agg(F.max(value))
    return wide.select(
        *row_keys, *[F.col(c).try_cast("double").alias(c) for c in columns], F.lit("unknown").alias("environment")
    )


def read_search_results(spark: SparkSession, folder: str, param_schema: str | None = None) -> DataFrame:
    """One row per tried setting of every search file ``hyperparameters__<dataset>__<method>.json``.

    Settings that were not reached have NULL scores; ``NaN`` scores (failed fits) stay NaN.
    """
    file = F.url_decode(F.col("_metadata.file_name"))
    texts = spark.read.text(f"{folder}/hyperparameters__*.json", wholetext=True).select(file.alias("file"), "value")
    return parse_search_results(texts, param_schema)


def parse_search_results(texts: DataFrame, param_schema: str | None = None) -> DataFrame:
    """The same from a table of texts (file, value); settings and scores are paired by place."""
    params = param_schema or "map<string,string>"
    schema = (
        f"params array<{params}>, mean_test_score array<double>, std_test_score array<double>, rank_test_score array<int>"
    )
    raw = texts.select("file", F.from_json("value", schema, {"allowNonNumericNumbers": "true"}).alias("r")).select("file", "r.*")
    return raw.select(
        F.regexp_extract("file", SEARCH_FILE, 1).alias("dataset"),
        F.regexp_extract("file", SEARCH_FILE, 2).alias("method"),
        F.posexplode(F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in raw.dtypes[1:]])).alias("pos", "s"),
    ).select("dataset", "method", "pos", "s.*")


def read_metafeatures(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the data-set name first; missing features count as 0."""
    raw = spark.read.option("header", True).csv(path)
    first, features = raw.columns[0], raw.columns[1:]
    return raw.select(
        F.col(first).alias("dataset"), *[F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c) for c in features]
    )


def combine_metafeatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two feature sets side by side; a data set in only one of them has NULLs in the other."""
    return left.join(right, "dataset", "full_outer")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN is written as missing, because NaN is not JSON."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    df.withColumns({d: F.when(~F.isnan(d), F.col(d)) for d in doubles}).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
