"""The table of registered queries and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent text for the checker, if any."""

    def wrap(build):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, build, sql)
        return build

    return wrap


def r6(value):
    """Six decimals, halves away from zero, by scaling (as the SQL twins round)."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 1e6, 0) / 1e6
