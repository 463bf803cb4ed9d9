"""Names of the queries, what builds them and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        """Decorator that registers a builder under ``name``, with the SQL that gives the same rows."""

        def keep(builder: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = builder
            if sql is not None:
                self.sql[name] = sql
            return builder

        return keep
