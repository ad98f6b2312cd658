"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplens.plans.tables import oracle
from shoplens.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator key, with equivalent SQL if there is any."""
    def add(run: Query) -> Query:
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return run(spark, sf_dir)
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = in_utc
        if sql:
            ORACLES[name] = oracle(sql)
        return run
    return add
