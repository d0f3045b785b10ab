"""Registry of queries: a name, the Spark plan over a ``Graph``, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kairograph.sources.testgraph import Graph, with_tables

PLANS: dict[str, Callable[[Graph], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a plan; ``sql`` names graph tables (``kg_...``), whose CTEs are put in front."""

    def add(plan: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        key = name or plan.__name__
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = plan
        if sql is not None:
            SQL[key] = with_tables(sql)
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for k, f in PLANS.items()}
