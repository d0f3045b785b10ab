"""Changes of tables as DataFrames: plain Parquet has no MERGE, so a change is a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; columns missing in ``new`` keep their value."""
    missing = [c for c in old.columns if c not in new.columns]
    filled = new.join(old.select(key, *missing), key, "left") if missing else new
    return old.join(new.select(key), key, "left_anti").unionByName(filled.select(old.columns))


def update(old: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """As ``upsert``, but keys that ``old`` lacks are not inserted."""
    return upsert(old, new.join(old.select(key), key, "left_semi"), key)


def insert(old: DataFrame, new: DataFrame, *unique: str) -> DataFrame:
    """Appends the rows whose unique key is not there yet, each key once."""
    return old.unionByName(new.dropDuplicates(list(unique)).join(old.select(*unique), list(unique), "left_anti"), allowMissingColumns=True)


def delete_nodes(nodes: DataFrame, edges: dict[str, tuple[DataFrame, tuple[str, ...]]], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the nodes in ``gone`` (uuid) and without every edge that touches them."""
    kept = nodes.join(gone, "uuid", "left_anti")
    out = {}
    for name, (table, ends) in edges.items():
        for end in ends:
            table = table.join(gone.select(F.col("uuid").alias(end)), end, "left_anti")
        out[name] = table
    return kept, out


def remove_episode(edges: DataFrame, episode: str) -> DataFrame:
    """Edges that only this episode supports go; others lose it from their list."""
    left = F.array_remove("episodes", episode)
    holds = F.array_contains("episodes", episode)
    return edges.where(~holds | (F.size(left) > 0)).withColumn("episodes", F.when(holds, left).otherwise(F.col("episodes")))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive schema evolution: missing columns appear, nulls get the default."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})
