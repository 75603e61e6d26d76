"""Registered queries: what each runs, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin."""

        def register(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return register


def load() -> Registry:
    """All queries of the core."""
    from . import answering, corpus, graphs, online, records, retrieval

    every = Registry()
    for module in (records, retrieval, corpus, graphs, answering, online):
        every.queries |= module.R.queries
        every.sql |= module.R.sql
    return every
