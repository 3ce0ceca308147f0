"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query function (taking :class:`aspectra.plans.bindings.Tables`) under its name."""

    def register(fn: Callable) -> Callable:
        from aspectra.plans.bindings import Tables

        QUERIES[fn.__name__] = lambda spark, sf_dir, f=fn: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = " ".join(sql.split("\n"))
        return fn

    return register
