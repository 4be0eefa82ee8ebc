"""Snapshots compared, findings planned, rates judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each key: added, removed, updated (with the fields that changed) or same."""
    b = before.select(F.col(key).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    a = after.select(F.col(key).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.lit(f)) for f in fields]))
    both = b.join(a, F.col("_b") == F.col("_a"), "full_outer").select(F.coalesce("_a", "_b").alias(key), "_a", "_b", changed.alias("c"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size("c") > 0, "updated").otherwise("same")
    return both.select(key, kind.alias("kind"), F.when(kind == "updated", F.array_join("c", ",")).otherwise("").alias("changed"))


def findings(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row for each check and row that fails it."""
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return df.select(F.col(key), F.explode(failed).alias("check"))


def breaker(plan: DataFrame, action: str, most: int) -> DataFrame:
    """The plan without an action that more than ``most`` rows ask for: then something else is wrong.  Rows without an action stay."""
    asks = F.coalesce(F.col("action") == action, F.lit(False))
    asked = plan.where(asks).agg(F.count("*").alias("n"))
    return plan.where(~asks | (asked.scalar() <= most))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, or null."""
    return reduce(lambda out, r: F.when(r[1], F.lit(r[0])).otherwise(out), reversed(reasons), F.lit(None).cast("string"))


def rates(df: DataFrame, by: list[str], predicates: dict[str, Column]) -> DataFrame:
    """Percent of rows for which each predicate holds; null where it never says anything."""
    one = lambda p: F.round(F.sum(F.when(p, 1.0).otherwise(F.when(p.isNotNull(), 0.0))) * 100.0 / F.count(p), 6)
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[one(p).alias(name) for name, p in predicates.items()])


def partition_check(parts: DataFrame, value: str, count: str, total: int) -> DataFrame:
    """Whether named parts are distinct and their counts add up."""
    return parts.agg((F.count("*") == F.countDistinct(value)).alias("distinct_parts"), (F.coalesce(F.sum(count), F.lit(0)) == total).alias("adds_up"), F.min(F.col(count) >= 0).alias("no_negative"))
