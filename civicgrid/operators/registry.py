"""Queries register here with the SQL that expresses the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; without ``sql`` it has no DuckDB counterpart."""

        def register(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.oracle[function.__name__] = sql
            return function

        return register
