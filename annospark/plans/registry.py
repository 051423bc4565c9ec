"""Registry of named queries: a Spark builder plus (optionally) its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # SURVEY §2 operator ids exercised


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from annospark.session import ship_package
            ship_package(spark)  # workers can import the package's UDF helpers
            return fn(spark, sf_dir)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, ids)
        return fn
    return deco
