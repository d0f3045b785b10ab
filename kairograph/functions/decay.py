"""Memory decay and effective confidence as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
POINTS_PER_DAY = 0.01
RECALL_BOOST, MAX_RECALL_BOOST = 0.04, 0.2
REINFORCEMENT_BOOST, MAX_REINFORCEMENT_BOOST = 0.03, 0.25
PROTECTED = ("constraint", "style", "preference", "goal", "trait", "self_model", "consolidated", "archived_summary")
HALF_LIFE_DAYS = {"episodic": 30.0, "reinforced": 90.0, "persistent": 365.0, "consolidated": float("inf")}


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, rounded down."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000))


def memory_class(value: Column) -> Column:
    out = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(out == "", F.lit("objective")).otherwise(out)


def is_protected(klass: Column, stability: Column) -> Column:
    return memory_class(klass).isin(*PROTECTED) | F.coalesce(stability == "consolidated", F.lit(False))


def linear_vitality(score: Column, klass: Column, stability: Column, last: Column, now: Column) -> Column:
    score = F.coalesce(score, F.lit(1.0))
    days = F.greatest(F.coalesce(days_between(last, now), F.lit(0)), F.lit(0))
    return F.when(is_protected(klass, stability), clip01(score)).otherwise(clip01(score - days * POINTS_PER_DAY))


def last_touched() -> Column:
    return F.coalesce("last_recalled_at", "last_reinforced_at", "valid_at", "created_at")


def effective_confidence(now: Column) -> Column:
    """Over the fact table's columns."""
    klass, stability = F.col("memory_class"), F.col("stability")
    base = clip01(F.col("confidence"))
    vitality = linear_vitality(F.col("decay_score"), klass, stability, last_touched(), now)
    count = F.greatest(F.coalesce(F.col("reinforcement_count"), F.lit(1)), F.lit(1))
    reinforced = F.least(F.lit(MAX_REINFORCEMENT_BOOST), F.log1p(count - 1) * REINFORCEMENT_BOOST)
    recalled = F.least(F.lit(MAX_RECALL_BOOST), F.greatest(F.coalesce(F.col("recall_count"), F.lit(0)), F.lit(0)) * RECALL_BOOST)
    return F.when(is_protected(klass, stability), base).otherwise(clip01(base * vitality + reinforced + recalled))


def half_life(stability: Column, overrides: dict[str, float] | None = None) -> Column:
    table = HALF_LIFE_DAYS | (overrides or {})
    out = F.lit(table["episodic"])
    for name, days in table.items():
        out = F.when(stability == name, F.lit(days)).otherwise(out)
    return out
