"""Queries by name, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.plans.context import Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)
