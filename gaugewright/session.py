"""Shared-folder tables used to cut lineage, and the package's way to the workers."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="gaugewright-")
    return _local_dirs[sc.applicationId]


def stages(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/gaugewright-{spark.sparkContext.applicationId}"


def new_stage(spark: SparkSession) -> str:
    """A path for one intermediate table."""
    return f"{stages(spark)}/stage-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Later branches scan the Parquet table (with column pruning) instead of repeating the work, and a lost
    executor costs only a re-read. `drop_stages` deletes the tables when no result needs them any more.
    """
    path = new_stage(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str) -> DataFrame:
    """Like `materialize`, in buckets by the hash of a column: a join on it moves only the rows of the other side.

    Buckets are known to the catalog only, so the table is in it until it has been read; its files stay.
    """
    spark = df.sparkSession
    name = f"gaugewright_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", new_stage(spark)).bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def drop_stages(spark: SparkSession) -> bool:
    """Deletes all intermediate tables of this application; results not yet written are lost with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stages(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="gaugewright-")) / "gaugewright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
