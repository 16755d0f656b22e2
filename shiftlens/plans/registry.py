"""Registered queries. A query is a function (spark, sf_dir) -> DataFrame; its SQL, for DuckDB, stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftlens.plans.fixtures import Domain, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: As given, for queries that must say the same.
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register fn(d: Domain) under its name, with SQL over the given tables and the fixture tables."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            SQL[key], ORACLES[key] = sql, with_fixtures(sql)
        return fn

    return add
