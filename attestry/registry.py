"""Names of all queries, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.tables import duckdb_sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("core", "retrieval", "reports", "changes", "texts", "streams")


class Inputs:
    """The tables of one query run, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self.seen)


def query(name: str, sql: str | None = None):
    """Registers a function of ``Inputs``; ``sql``: what DuckDB must also give."""

    def add(fn: Callable[[Inputs], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            _ORACLES[name] = duckdb_sql(sql)
        return fn

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"attestry.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
