"""Keyed caches of computed fields: look-up, refill, pruning, admission by budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(rows: DataFrame, cache: DataFrame, key: list[str], valid: Column | None = None) -> DataFrame:
    """Rows with what the cache holds for them (``hit``, ``value``); entries that ``valid`` (on c_ columns) rejects are misses."""
    c = cache.select(*[F.col(x).alias(f"c_{x}") for x in cache.columns])
    if valid is not None:
        c = c.where(valid)
    on = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in key]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return rows.join(c, cond, "left").withColumn("hit", F.col(f"c_{key[0]}").isNotNull()).withColumn("value", F.col("c_value")).drop(*[f"c_{x}" for x in cache.columns])


def upsert(cache: DataFrame, new: DataFrame, key: list[str], pinned: str = "reviewed", replace: bool = False) -> DataFrame:
    """The cache with new entries: pinned ones never change, others only with ``replace``; one shuffle by key."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    keep = F.when(F.coalesce(F.col(pinned), F.lit(False)) & (F.col("_new") == 0), 0).otherwise(F.when(F.lit(replace), 2 - F.col("_new")).otherwise(1 + F.col("_new")))
    rest = [c for c in cache.columns if c not in key]
    best = both.groupBy(*key).agg(F.min_by(F.struct(*rest), keep).alias("r"))
    return best.select(*key, *[F.col("r").getField(c).alias(c) for c in rest])


def pruned(entries: DataFrame, live: DataFrame, key: str, digest: str, healed: DataFrame) -> DataFrame:
    """Entries whose row still exists with the same digest and hasn't healed."""
    rows = entries.join(live.select(F.col(key).alias("_l"), F.col(digest).alias("_d")), (F.col(key) == F.col("_l")) & (F.col(digest) == F.col("_d")), "left_semi")
    return rows.join(healed.select(F.col(key).alias("_h")), F.col(key) == F.col("_h"), "left_anti")


def merge_requests(*requests: DataFrame) -> DataFrame:
    """The latest request of each id."""
    out = requests[0]
    for r in requests[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.max("requested_at").alias("requested_at"))


def due(rows: DataFrame, requests: DataFrame, made_at: str) -> DataFrame:
    """Rows that were asked for after they were made."""
    r = requests.select(F.col("id").alias("_r"), "requested_at")
    return rows.join(r, F.col("id") == F.col("_r")).where(F.col(made_at).isNull() | (F.col(made_at) < F.col("requested_at"))).drop("_r", "requested_at")


def admitted(rows: DataFrame, miss: Column, order: list[Column], most: int) -> DataFrame:
    """Adds ``route``: apply (a hit), compute (the first ``most`` misses in order), or skip.

    The number of misses before a row is taken from the first ``most`` alone, which a top-k finds without sorting the table.
    """
    first = rows.where(miss).orderBy(*order).limit(most).select(F.col("id").alias("_a"))
    rows = rows.join(first, F.col("id") == F.col("_a"), "left")
    return rows.withColumn("route", F.when(~miss, "apply").when(F.col("_a").isNotNull(), "compute").otherwise("skip")).drop("_a")


def attempts(state: DataFrame, tried: DataFrame, failing: DataFrame) -> DataFrame:
    """Attempt counters: carried for ids that still fail, one more for those tried now, forgotten for the healed."""
    s = state.select(F.col("id").alias("s"), F.col("n").alias("was"))
    t = tried.select(F.col("id").alias("t")).distinct()
    rows = failing.select("id").distinct().join(s, F.col("id") == F.col("s"), "left").join(t, F.col("id") == F.col("t"), "left")
    return rows.select("id", (F.coalesce("was", F.lit(0)) + F.when(F.col("t").isNotNull(), 1).otherwise(0)).cast("long").alias("n")).where("n > 0")


def retained(processed: DataFrame, at: str, today: Column, days: int = 14) -> DataFrame:
    return processed.where(F.col(at) >= F.date_sub(today, days))


def planned(findings: DataFrame, policy: DataFrame, counts: DataFrame, most: int = 3) -> DataFrame:
    """One action for each failing id: the strictest that its checks ask for; requests that were tried ``most`` times are parked."""
    order = F.create_map(*[F.lit(x) for p in (("withhold", 0), ("correct", 1), ("requeue", 2), ("note", 3)) for x in p])
    rows = findings.join(policy, "check").groupBy("id").agg(F.min_by("action", F.element_at(order, F.col("action"))).alias("action"), F.array_sort(F.collect_set("check")).alias("checks"))
    rows = rows.join(counts.select(F.col("id").alias("c"), "n"), F.col("id") == F.col("c"), "left")
    parked = (F.col("action") == "requeue") & (F.coalesce("n", F.lit(0)) >= most)
    return rows.select("id", F.when(parked, "parked").otherwise(F.col("action")).alias("action"), F.array_join("checks", ",").alias("checks"))
