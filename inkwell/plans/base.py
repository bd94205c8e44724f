"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, each with its equivalent in SQL where it has one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Registers ``f(t)``, where ``t(name)`` is an input table, under the function's name."""

        def put(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: table(spark, sf_dir, name))

            self.queries[f.__name__] = run
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put
