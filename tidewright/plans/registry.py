"""Registration of queries: a function of (spark, sf_dir), and DuckDB SQL with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name. Its first parameter is a function from a table's name to its DataFrame."""

    def add(make: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add
