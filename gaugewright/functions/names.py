"""Names: hardware, software, data-set variants, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns for Intel, AMD and ARM processor names, each with a text that it cannot do without.
CPU_PATTERNS = [
    ("Intel(R) ", r"^.*(Intel)\(R\) \S* (\S*).*"),
    (" AMD ", r"^\S* (AMD) \S* (\S*) .*"),
    ("ARM", r"^(ARM\S+) Processor (.*)"),
]
# Fixed value: pattern of a variant of a data set.
VARIANT = r"^v(\d)_(\d)___(.*)"


def hardware_name(cpu: Column) -> Column:
    """Short processor name; unknown processors keep their first 13 characters."""
    name = F.concat(F.substring(cpu, 1, 13), F.lit(".."))
    for text, pattern in reversed(CPU_PATTERNS):
        # plain search first: most names meet one pattern only
        name = F.when(cpu.contains(text) & cpu.rlike(pattern), F.regexp_replace(cpu, pattern, "$1 $2")).otherwise(name)
    return name


def software_name(package: str, requirements: Column) -> Column:
    """``package version`` from the first matching ``name==version`` entry."""
    def plain(name: Column) -> Column:
        return F.lower(F.replace(name, F.lit("-"), F.lit("_")))

    wanted = package.replace("-", "_").lower()
    match = F.get(F.filter(requirements, lambda r: plain(F.split_part(r, F.lit("=="), F.lit(1))) == wanted), F.lit(0))
    version = F.coalesce(F.split_part(match, F.lit("=="), F.lit(2)), F.lit("n.a."))
    return F.concat_ws(" ", F.lit(package), version)


def variant_name(dataset: Column, number: Column, of: Column) -> Column:
    return F.concat(F.lit("v"), number, F.lit("_"), of, F.lit("___"), dataset)


def parse_variant(name: Column) -> tuple[Column, Column, Column]:
    """Variant number, number of variants and base data set; plain names have no variant."""
    is_variant = name.rlike(VARIANT)
    number, of = (F.when(is_variant, F.regexp_extract(name, VARIANT, g).cast("int")) for g in (1, 2))
    return number, of, base_dataset(name)


def base_dataset(name: Column) -> Column:
    return F.when(name.rlike(VARIANT), F.regexp_extract(name, VARIANT, 3)).otherwise(name)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def title_of(key: Column, known: Column) -> Column:
    """Display name: made up for ``*_index`` keys, else the known one, else the key itself."""
    made_up = F.concat(capitalize(F.replace(key, F.lit("_index"), F.lit(""))), F.lit(" Index"))
    return F.when(key.contains("_index"), made_up).otherwise(F.coalesce(known, key))
