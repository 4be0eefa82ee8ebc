"""Work ledgers: stages with first times, holds, slots, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import first_reason


def stamped(previous: DataFrame, current: DataFrame, stages: list[str], now: Column) -> DataFrame:
    """Best stage and first time of each stage reached, a row a key.

    ``previous`` has key, best and a column for each stage (its first time, or null); ``current`` key and stage. A
    key's best never falls; lower stages that were skipped get the same time; times once set stay.
    """
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])
    c = current.select(F.col("key").alias("k"), F.element_at(rank, F.col("stage")).alias("at"))
    p = previous.select(F.col("key").alias("p"), F.col("best").alias("was"), *[F.col(s).alias(f"p_{s}") for s in stages])
    rows = c.join(p, F.col("k") == F.col("p"), "full_outer").withColumn("now_at", F.greatest("at", "was"))
    first = [F.coalesce(f"p_{s}", F.when(F.col("at") >= i, now)).alias(s) for i, s in enumerate(stages)]
    return rows.select(F.coalesce("k", "p").alias("key"), F.col("now_at").cast("int").alias("best"), *first)


def stage_ladder(gates: list[tuple[str, Column]], done: str) -> Column:
    """The stage of the first gate that isn't met."""
    return F.coalesce(first_reason([(name, ~met) for name, met in gates]), F.lit(done))


def held(hold: Column, until: Column, today: Column, now_print: Column, then_print: Column) -> Column:
    """A hold lasts until its date or until what it is about has changed."""
    return F.coalesce(hold & (until.isNull() | (today <= until)) & now_print.eqNullSafe(then_print), F.lit(False))


def slots(tiers: list[DataFrame], key: str, order: list[Column], most: int) -> DataFrame:
    """Candidates of several tiers in their order, each key once, the first ``most``."""
    rows = None
    for i, tier in enumerate(tiers):
        t = tier.withColumn("tier", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col("tier")).alias("r")).select("r.*")
    return best.orderBy("tier", *order).limit(most)


def collapsed(actions: DataFrame) -> DataFrame:
    """One action a workflow, with all keys and reasons."""
    return actions.groupBy("workflow").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def stamp_if_changed(new: DataFrame, old: DataFrame, key: str, fields: list[str], stamp: str) -> DataFrame:
    """The old stamp where nothing else has changed."""
    o = old.select(F.col(key).alias("_k"), F.col(stamp).alias("_s"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_o_{f}"))
    rows = new.join(o, F.col(key) == F.col("_k"), "left")
    return rows.select(*[F.when(F.col("_k").isNotNull() & same, F.col("_s")).otherwise(F.col(stamp)).alias(stamp) if c == stamp else F.col(c) for c in new.columns])
