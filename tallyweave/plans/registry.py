"""Registration of a query and, where SQL can express it, of its statement for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.tables import Tables, with_views


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        if name in self.QUERIES:
            raise ValueError(f"{name} is registered twice")

        def add(build: Callable[[Tables], DataFrame]) -> Callable:
            self.QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self.SQL[name] = with_views(sql)
            return build

        return add
