"""Every registered query and its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kairograph.plans import registry

MODULES = ("scans", "filters", "joins", "aggregates", "windows", "scalars", "search", "temporal", "cognition", "portable", "hooks")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"kairograph.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as of a time, after slot closure."""
    return queries()["tf_facts_as_of"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
