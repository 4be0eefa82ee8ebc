"""The flagship plan: score, filter, classify, resolve, rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules
from .ranking import ranked


@dataclass(frozen=True)
class Policy:
    """What a publication scores, keeps and prefers."""

    weights: Sequence[tuple[str, float]]
    noise: Sequence[str] = ()
    rescue: Sequence[str] = ()
    areas: Sequence[rules.Rule] = ()
    stages: Sequence[rules.Rule] = ()
    floor: float = 1.0
    stage_bonus: dict[str, float] = field(default_factory=dict)
    default_area: str = "Other"
    default_stage: str = "Update"


def scored(df: DataFrame, text: str, policy: Policy, exempt: Column, gate: Column | None = None) -> DataFrame:
    """Rows that pass the exclusion and the floor, with ``score``, ``area`` and ``stage``; one projection, no shuffle."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.where(~rules.excluded_unless_rescued(low, policy.noise, policy.rescue)).withColumn("score", rules.keyword_score(low, policy.weights))
    rows = rows.where(rules.above_floor(F.col("score"), policy.floor, exempt))
    return rows.withColumn("area", rules.first_match(low, policy.areas, policy.default_area, gate)).withColumn("stage", rules.first_match(low, policy.stages, policy.default_stage, gate))


def published(df: DataFrame, text: str, key: str, policy: Policy, exempt: Column, at: Column, now: Column, gate: Column | None = None) -> DataFrame:
    """Scored rows in their order of relevance: score, stage bonus and age; ties by key."""
    rows = scored(df, text, policy, exempt, gate)
    bonus = F.lit(0.0)
    for stage, value in policy.stage_bonus.items():
        bonus = F.when(F.col("stage") == stage, F.lit(float(value))).otherwise(bonus)
    rows = rows.withColumn("order_score", F.round(F.col("score") + bonus - rules.recency_penalty(at, now), 6))
    return ranked(rows, F.col("order_score"), F.col(key))


def carried_forward(new: DataFrame, old: DataFrame, key: str, url: str, fields: list[str]) -> DataFrame:
    """Fields of a row's earlier version, where key and URL are still the same; else the new ones."""
    prior = old.select(F.col(key).alias("_k"), F.col(url).alias("_u"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    rows = new.join(prior, (F.col(key) == F.col("_k")) & F.col(url).eqNullSafe(F.col("_u")), "left")
    return rows.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in fields else F.col(c) for c in new.columns])


def with_stage(df: DataFrame, stage: str, deadline: str, now: Column) -> DataFrame:
    return df.withColumn(stage, dates.resolve_stage(F.col(stage), F.col(deadline), now))
