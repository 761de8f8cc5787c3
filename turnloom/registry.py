"""Registry of named queries, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under its name; ``ops`` are SURVEY ids it covers."""

    def add(f: Callable[["Tables"], DataFrame]) -> Callable[["Tables"], DataFrame]:
        if f.__name__ in _QUERIES:
            raise ValueError(f"query {f.__name__} is registered twice")
        _QUERIES[f.__name__] = Query(f.__name__, ops, lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def registered(name: str) -> Query:
    return _QUERIES[name]


class Tables:
    """The driver's tables by attribute, read lazily: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def load() -> dict[str, Query]:
    """All queries, once every module of ``turnloom.plans`` has been imported."""
    from turnloom import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")
    return dict(_QUERIES)
