"""Registered queries: a Spark builder and, where SQL can say it, the equivalent SQL over the same tables."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chorale.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(Views(spark, root))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        # a tie at the seventh place falls the same way in both engines, whatever the order of a sum (see r6)
        QUERIES[name] = Query(name, build, sql and sql.replace(",6)", "+1e-10,6)"))
        return build

    return register
