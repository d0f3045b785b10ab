"""Relation frames: predicate metadata, a small dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    canonical: str
    aliases: tuple[str, ...]
    direction: str
    temporal: str
    cardinality: str
    policy: str
    confidence: float
    inverse: str | None = None


#: The seed frames, in registration order (the last registration of an alias wins).
SEED_FRAMES = (
    Frame("spouse_of", ("wife_of", "husband_of", "married_to", "partner_of"), "symmetric", "state", "one_current", "replace", 0.9),
    Frame("parent_of", ("father_of", "mother_of", "mom_of", "dad_of"), "inverse_pair", "timeless", "many_current", "coexist", 0.9, "child_of"),
    Frame("child_of", ("son_of", "daughter_of"), "inverse_pair", "timeless", "many_current", "coexist", 0.9, "parent_of"),
    Frame("sibling_of", ("brother_of", "sister_of"), "symmetric", "timeless", "many_current", "coexist", 0.9),
    Frame("friend_of", ("friends_with",), "symmetric", "state", "many_current", "coexist", 0.7),
    Frame("lives_in", ("resides_in", "based_in", "located_in", "from"), "directed", "state", "one_current", "replace", 0.85),
    Frame("works_at", ("employed_by", "employee_of", "works_for"), "directed", "state", "one_current", "replace", 0.85),
    Frame("member_of", ("belongs_to", "part_of"), "directed", "state", "many_current", "coexist", 0.7),
    Frame("owns", ("has", "possesses"), "directed", "state", "many_current", "coexist", 0.7),
    Frame("owns_pet", ("has_pet", "owns_dog", "owns_cat", "pet_is"), "directed", "state", "many_current", "coexist", 0.8),
    Frame("is_named", ("is_called", "is_aka", "name_is", "goes_by"), "directed", "state", "many_current", "coexist", 0.95),
    Frame("born_in", ("was_born_in", "birthplace_is"), "directed", "timeless", "one_current", "replace", 0.95),
    Frame("located_in", ("situated_in", "found_in"), "directed", "state", "one_current", "replace", 0.7),
    Frame("contains", ("includes", "holds"), "inverse_pair", "state", "many_current", "coexist", 0.7, "part_of"),
    Frame("precedes", ("before", "happens_before"), "inverse_pair", "event", "many_historical", "coexist", 0.7, "follows"),
)

_SCHEMA = "canonical string, alias string, n int, direction string, inverse string, temporal string, cardinality string, policy string, confidence double"


def frame_rows(spark: SparkSession, frames: tuple[Frame, ...] = SEED_FRAMES, first: int = 0) -> DataFrame:
    """One row per (frame, alias), the canonical name included; n is the registration order."""
    rows = [(f.canonical, a, n, f.direction, f.inverse, f.temporal, f.cardinality, f.policy, f.confidence) for n, f in enumerate(frames, first) for a in (f.canonical, *f.aliases)]
    return spark.createDataFrame(rows, _SCHEMA)


def latest_aliases(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per alias (and further keys): the last registration."""
    rank = F.row_number().over(Window.partitionBy(*keys, "alias").orderBy(F.desc("n")))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def frame_aliases(spark: SparkSession) -> DataFrame:
    return latest_aliases(frame_rows(spark))


def merge_frames(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Folds the source frame and its aliases into the target frame."""
    meta = ["canonical", "n", "direction", "inverse", "temporal", "cardinality", "policy", "confidence"]
    to = rows.where(F.col("canonical") == target).select(*meta).distinct()
    moved = rows.where(F.col("canonical") == source).select("alias").join(F.broadcast(to.limit(1)), how="cross").select(rows.columns)
    kept = rows.where(F.col("canonical") != source)
    return kept.unionByName(moved).dropDuplicates(["canonical", "alias"])
