"""Property dimension: what each measured property means and how it is rated."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_KEYS = ("dataset", "task", "environment")
QUANTILES = (0.8, 0.6, 0.4, 0.2)
DEFAULT_BOUNDS = (0.9, 0.8, 0.7, 0.6)
TOP, BOTTOM = 100000.0, -100.0


@dataclass(frozen=True)
class Property:
    key: str
    title: str
    shortname: str
    unit: str
    group: str
    weight: float
    maximize: bool = False
    independent: bool = False


# The ten rated properties with unit, group and weight.
DEFAULT_PROPERTIES = (
    Property("accuracy", "Accuracy", "ACC", "percent", "Performance", 0.125, True, True),
    Property("f1", "F1 Score", "F1", "percent", "Performance", 0.125, True, True),
    Property("precision", "Precision", "PRC", "percent", "Performance", 0.125, True, True),
    Property("recall", "Recall", "REC", "percent", "Performance", 0.125, True, True),
    Property("parameters", "Number of Parameters", "PAR", "number", "Resources", 0.0833333333, False, True),
    Property("fsize", "Model Size on Disc", "FS", "byte", "Resources", 0.0833333333, False, True),
    Property("train_power_draw", "Training Energy Draw", "ENT", "wattseconds", "Resources", 0.0833333333),
    Property("train_running_time", "Training Time", "RTT", "seconds", "Resources", 0.0833333333),
    Property("power_draw", "Energy Draw per Inference", "ENI", "wattseconds", "Resources", 0.0833333333),
    Property("running_time", "Running Time per Inference", "RTI", "seconds", "Resources", 0.0833333333),
)
PROPERTY_KEYS = tuple(p.key for p in DEFAULT_PROPERTIES)

META_SCHEMA = (
    "property string, position int, name string, shortname string, unit string, grp string, "
    "weight double, maximize boolean, independent boolean"
)


def unknown_property(key: str) -> Property:
    """Meta of a numeric column that the configuration does not describe."""
    return Property(key, key, key[:4], "number", "Performance", 1.0)


def rateable(df: DataFrame, properties=None) -> tuple[Property, ...]:
    """Numeric columns that can be rated; without configured properties every numeric column counts."""
    numeric = {
        f.name for f in df.schema.fields
        if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    }
    if properties is None:
        found = tuple(unknown_property(c) for c in df.columns if c in numeric)
    else:
        found = tuple(p for p in properties if p.key in numeric)
    if not found:
        raise ValueError("no rateable property among the columns")
    return found


def with_weights(properties, weights: dict[str, float]) -> tuple[tuple[Property, ...], bool]:
    """Properties with changed weights, and whether anything changed."""
    changed = tuple(replace(p, weight=float(weights.get(p.key, p.weight))) for p in properties)
    return changed, changed != tuple(properties)


def weights_json(properties) -> str:
    return json.dumps({p.key: p.weight for p in properties}, indent=4)


def meta_frame(spark: SparkSession, properties=DEFAULT_PROPERTIES) -> DataFrame:
    """The property dimension as a table; its size is the number of configured properties."""
    rows = [
        (p.key, i, p.title, p.shortname, p.unit, p.group, p.weight, p.maximize, p.independent)
        for i, p in enumerate(properties)
    ]
    return spark.createDataFrame(rows, META_SCHEMA)


def load_meta(spark: SparkSession, directory: str) -> dict:
    """Configuration files ``meta_<key>.json`` of a folder that Spark reads, keyed by ``<key>``; a handful of small files."""
    name = F.url_decode(F.col("_metadata.file_name"))
    found = spark.read.text(f"{directory}/meta_*.json", wholetext=True).select(name.alias("name"), "value").collect()
    return {r["name"][len("meta_"):-len(".json")]: json.loads(r["value"]) for r in sorted(found)}


def properties_from_meta(config: dict) -> tuple[Property, ...]:
    return tuple(
        Property(
            key, m["name"], m.get("shortname", key[:4]), m["unit"], m["group"], float(m["weight"]),
            bool(m.get("maximize", False)), bool(m.get("independent_of_task", False)),
        )
        for key, m in config["properties"].items()
    )
