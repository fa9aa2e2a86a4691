"""Run directories, merged logs and property extraction."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.names import hardware_name, software_name
from gaugewright.functions.scalars import nan_to_null, once
from gaugewright.session import materialize

CONFIG = "struct<ds:string,method:string,seed:bigint,timestamp:string>"
RESULTS = (
    "struct<model:struct<params:double,fsize:double,hyperparam_sensitivity:double>,"
    "metrics:struct<accuracy:double,f1:double,precision:double,recall:double,top_5_accuracy:double>,"
    "data:struct<shape:struct<train:array<bigint>,test:array<bigint>>>>"
)
PLATFORM = "struct<Processor:string,System:string>"
EMISSION = "struct<duration:double,energy_consumed:double>"
LOG_SCHEMA = (
    f"directory_name string, config {CONFIG}, results {RESULTS}, execution_platform {PLATFORM}, "
    f"requirements array<string>, emissions array<{EMISSION}>"
)
RUN_FILES = {"config.json": CONFIG, "results.json": RESULTS, "execution_platform.json": PLATFORM}
ALL_FILES = (*RUN_FILES, "requirements.txt", "emissions.csv")
AT_ONCE = 10_000  # directories that one scan opens

# after a comma a field is quoted, with doubled quotes inside, or runs to the next comma
_FIELD = r',("[^"]*(?:""[^"]*)*"|[^,]*)'


def _named(path: Column) -> tuple[Column, Column]:
    """Run directory and file name of an encoded path (in which a plus sign is one)."""
    directory = F.replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B"))
    return F.url_decode(directory), F.regexp_extract(path, r"([^/]+)$", 1)


def escaped(name: str) -> str:
    """A directory name in which no character stands for others."""
    return re.sub(r"([\\\[\]{}*?,^])", r"\\\1", name)


def read_run_files(spark: SparkSession, root: str, directories: list[str] | None = None) -> DataFrame:
    """Texts of the known files of all (or the named) run directories in one scan: directory_name, file, value."""
    names = "{" + ",".join(ALL_FILES) + "}"
    paths = [f"{root}/*/{names}"] if directories is None else [f"{root}/{escaped(d)}/{names}" for d in directories]
    directory, file = _named(F.col("_metadata.file_path"))
    return spark.read.text(paths, wholetext=True).select(directory.alias("directory_name"), file.alias("file"), "value")


def list_run_directories(spark: SparkSession, root: str) -> DataFrame:
    """Names of the run directories; no file is opened."""
    listed = spark.read.format("binaryFile").load(f"{root}/*/{{{','.join(ALL_FILES)}}}")
    return listed.select(_named(F.col("_metadata.file_path"))[0].alias("directory_name")).distinct()


def parse_emissions(text: Column) -> Column:
    """Rows of an emissions file in order (0 is training, 1 inference); quoted fields may hold commas.

    Every line is cut into fields once, and only the header and the wanted fields are unquoted.
    """
    names = ("duration", "energy_consumed")
    lines = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")

    def fields(line: Column) -> Column:
        return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))

    def plain(field: Column) -> Column:
        quoted = F.replace(F.regexp_replace(F.trim(field), '^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.when(F.contains(field, F.lit('"')), quoted).otherwise(F.trim(field))

    def places(header: Column) -> Column:
        return F.struct(*[F.nullif(F.array_position(header, n), F.lit(0)).cast("int").alias(n) for n in names])

    def row(raw: Column, at: Column) -> Column:
        return F.struct(*[plain(F.get(raw, at[n] - 1)).try_cast("double").alias(n) for n in names])

    def rows(lines: Column, at: Column) -> Column:
        others = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.transform(others, lambda line: once(fields(line), lambda raw: row(raw, at)))

    return once(lines, lambda some: once(
        once(F.transform(fields(F.get(some, F.lit(0))), plain), places), lambda at: rows(some, at)
    ))


def parse_requirements(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"\s+$", ""), "\n"), lambda line: F.trim(F.replace(line, F.lit("\r"), F.lit(""))))


def assemble_runs(files: DataFrame) -> DataFrame:
    """One row per run directory from its files; a missing or broken file leaves NULL, other files are ignored.

    Texts are aggregated by sorting. Names share their beginnings, so that a number made from the name comes first in the order.
    """
    def of(name: str) -> Column:
        return F.max(F.when(F.col("file") == name, F.col("value"))).alias(name)

    texts = files.groupBy(F.xxhash64("directory_name").alias("_mark"), "directory_name").agg(*[of(n) for n in ALL_FILES])
    return texts.select(
        "directory_name", *[F.from_json(F.col(f"`{n}`"), schema).alias(n.split(".")[0]) for n, schema in RUN_FILES.items()],
        parse_requirements(F.col("`requirements.txt`")).alias("requirements"),
        parse_emissions(F.col("`emissions.csv`")).alias("emissions"),
    )


def read_run_directories(spark: SparkSession, root: str, directories: list[str] | None = None) -> DataFrame:
    return assemble_runs(read_run_files(spark, root, directories))


def parse_merged_logs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged logs from texts (column value) of one JSON object each, and the rejected texts (_corrupt).

    Emissions may be a list of rows, or columns as ``{"duration": {"0": ..., "1": ...}, ...}``.
    """
    schema = LOG_SCHEMA.rsplit(", emissions", 1)[0] + ", emissions string, _corrupt string"
    log = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = texts.select("value", F.explode(F.array(log)).alias("log"))  # no filter moves into the parser and repeats it
    bad = F.col("log").isNull() | F.col("log._corrupt").isNotNull()

    def turned(columns: Column) -> Column:
        places = F.array_sort(F.transform(F.map_keys(F.coalesce(columns["duration"], columns["energy_consumed"])), lambda k: k.cast("int")))
        return F.transform(places, lambda i: F.struct(*[
            F.try_element_at(columns[n], i.cast("string")).alias(n) for n in ("duration", "energy_consumed")
        ]))

    rows = F.from_json("log.emissions", f"array<{EMISSION}>")
    columns = F.from_json("log.emissions", "struct<duration:map<string,double>,energy_consumed:map<string,double>>")
    emissions = F.when(F.col("log.emissions").startswith("{"), once(columns, turned)).otherwise(rows)
    good = parsed.filter(~bad).select("log.*", emissions.alias("_emissions")).drop("_corrupt", "emissions")
    return good.withColumnRenamed("_emissions", "emissions"), parsed.filter(bad).select(F.col("value").alias("_corrupt"))


def read_merged_logs(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged logs of a folder, one JSON object per file (indented or not) or per line, and the rejected texts."""
    return parse_merged_logs(spark.read.text(folder, wholetext=not lines).filter(F.trim("value") != ""))


def new_runs(incoming: DataFrame, known: DataFrame, key: str = "directory_name") -> DataFrame:
    """Runs whose directory has not been merged yet."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def ingest_directories(spark: SparkSession, root: str, bronze: str) -> DataFrame:
    """Append the logs of unseen run directories to the bronze table.

    Directories are listed and compared by name first, so files of known ones are not opened again.  New names come to
    the driver ``AT_ONCE`` at a time, as paths of one scan each; a run that is cut off goes on where it stopped.
    """
    try:
        known = spark.read.schema(LOG_SCHEMA).parquet(bronze)
        known.select("directory_name").limit(1).collect()
    except Exception as error:  # the table does not exist before the first ingestion
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], LOG_SCHEMA)
    fresh = materialize(new_runs(list_run_directories(spark, root), known).select("directory_name"))
    names = (r[0] for r in fresh.toLocalIterator())
    while some := sorted(itertools.islice(names, AT_ONCE)):
        read_run_directories(spark, root, some).write.mode("append").parquet(bronze)
    return spark.read.schema(LOG_SCHEMA).parquet(bronze)


def _per_sample(value: Column) -> Column:
    return F.try_divide(value, F.get(F.col("results.data.shape.test"), F.lit(0)).cast("double"))


def _emission(row: int, name: str) -> Column:
    return F.get(F.col("emissions"), F.lit(row))[name]


def default_extractors() -> dict[str, dict[str, Column]]:
    """Columns per task prefix of the run name; ``meta`` applies to every run.

    Fixed value: 3.6e6 watt seconds per kilowatt hour.
    """
    metrics = {m: F.col(f"results.metrics.{m}") for m in ("accuracy", "f1", "precision", "recall")}
    return {
        "meta": {
            "task": F.split_part("directory_name", F.lit("_"), F.lit(1)),
            "dataset": F.col("config.ds"),
            "model": F.col("config.method"),
            "architecture": hardware_name(F.col("execution_platform.Processor")),
            "software": software_name("Scikit-learn", F.col("requirements")),
        },
        "train": {
            "train_running_time": _emission(0, "duration"),
            "train_power_draw": _emission(0, "energy_consumed") * 3.6e6,
            "running_time": _per_sample(_emission(1, "duration")),
            "power_draw": _per_sample(_emission(1, "energy_consumed") * 3.6e6),
            "parameters": F.col("results.model.params"),
            "fsize": F.col("results.model.fsize"),
            **metrics,
        },
    }


def extract_properties(logs: DataFrame, extractors: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """One flat row per log.  An extractor that finds nothing, or does not apply to the task, gives NULL."""
    extractors = extractors or default_extractors()
    found: dict[str, Column] = {}
    for task, columns in extractors.items():
        applies = F.lit(True) if task == "meta" else F.col("directory_name").startswith(task)
        for name, column in columns.items():
            found[name] = F.when(applies, column).otherwise(found.get(name, F.lit(None)))
    flat = logs.select(F.col("directory_name").alias("log_name"), *[c.alias(n) for n, c in found.items()])
    doubles = [f.name for f in flat.schema.fields if f.dataType.typeName() in ("double", "float")]
    return flat.withColumns({d: nan_to_null(F.col(d)) for d in doubles}) if doubles else flat
