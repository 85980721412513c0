"""Registry of named queries: each name has a Spark function over the projected graph and, where SQL can say it, a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.oracle_tables import with_tables
from loomgraph.projection import Graph

QUERIES: dict[str, Callable[[Graph], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(graph) -> DataFrame`` under a name, with its SQL twin."""
    def add(fn: Callable[[Graph], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def oracles() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in ORACLES.items()}


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Graph(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
