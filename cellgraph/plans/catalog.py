"""Registry of named queries: a Spark builder, and SQL text where SQL can express the query."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import Views, with_views

FAMILIES = ("spatial", "io", "matching", "lineage", "scoring", "classifier", "audits", "frames", "registry")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"cellgraph.plans.{family}")
    return QUERIES


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return q.build(Views(spark, folder))

    run.__name__ = q.name
    return run


def r6(value) -> Column:
    """Six digits, and no negative zero, so that two engines print the same number."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), 6) + F.lit(0.0)
