"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture import Graph, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *fixtures: str):
    """Register a function of the graph; `sql` may go on with further common tables after a comma."""

    def register(make: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Graph(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLE[name] = (with_fixtures(*fixtures) + ("" if body.startswith(",") else " ") + body) if fixtures else body
        return make

    return register
