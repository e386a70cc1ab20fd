"""Name -> (query, SQL)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add
