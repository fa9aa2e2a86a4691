"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(value) -> Column:
    """Six digits for display and comparison; the offset settles exact halves upwards, whatever the last bit."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, 6)
