"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of a workspace under a name, with its check SQL."""

    def wrap(build: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Workspace(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap
