"""Joining group tables back to rows so that no row vanishes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups(df: DataFrame, groups: DataFrame, keys, how: str = "left") -> DataFrame:
    """Rows with the columns of their group; NULL is a key like any other."""
    renamed = groups.withColumnsRenamed({k: f"_{k}_of_group" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}_of_group")) for k in keys])
    joined = df.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_{k}_of_group" for k in keys])
