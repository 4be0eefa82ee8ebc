"""Deadlines taken over from a matching record, where exactly one matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import closes_at, strict_date


def propagate(targets: DataFrame, sources: DataFrame, key: str, day: str, extra: Column, most_days: int = 1) -> DataFrame:
    """For each target the outcome of its match and, if it is one, the source's deadline.

    A source matches by equal ``key``, days at most ``most_days`` apart and ``extra`` (a condition on t_ and s_ columns).
    Outcomes, the first that holds: invalid (a candidate's deadline can't be read), conflicting (different
    deadlines), ambiguous (several candidates, or the candidate has several targets), matched, none.
    """
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    near = F.abs(F.datediff(F.col(f"t_{day}"), F.col(f"s_{day}"))) <= most_days
    pairs = t.join(s, (F.col(f"t_{key}") == F.col(f"s_{key}")) & near & extra)
    pairs = pairs.withColumn("_targets", F.count("*").over(Window.partitionBy("s_id")))
    readable = closes_at(F.col("s_deadline"))
    per = pairs.groupBy("t_id").agg(
        F.count("*").alias("n"), F.countDistinct(readable).alias("deadlines"), F.count_if(readable.isNull()).alias("invalid"),
        F.max("_targets").alias("back"), F.min("s_id").alias("source_id"), F.min("s_deadline").alias("deadline"),
    )
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("invalid") > 0, "invalid").when(F.col("deadlines") > 1, "conflicting").when((F.col("n") > 1) | (F.col("back") > 1), "ambiguous").otherwise("matched")
    rows = targets.select(F.col("id")).join(per, F.col("id") == F.col("t_id"), "left").withColumn("outcome", outcome)
    ok = F.col("outcome") == "matched"
    return rows.select("id", "outcome", F.when(ok, F.col("source_id")).alias("source_id"), F.when(ok, F.col("deadline")).alias("deadline"))


def open_soon(df: DataFrame, deadline: str, now: Column, today: Column, horizon: int | None = None) -> DataFrame:
    """Rows whose deadline is ahead, with ``days_left`` to the last day; within ``horizon`` days if stated."""
    from ..functions.dates import last_day

    rows = df.where(closes_at(F.col(deadline)) > now).withColumn("days_left", F.datediff(last_day(F.col(deadline)), today))
    return rows if horizon is None else rows.where(F.col("days_left").between(0, horizon))


def seen_on(df: DataFrame, first_seen: str, today: Column, days: int, processed: DataFrame, key: str) -> DataFrame:
    """Rows first seen in the last ``days`` days and today, that were not processed."""
    day = strict_date(F.col(first_seen))
    rows = df.where(day.between(F.date_sub(today, days), today))
    return rows.join(processed.select(F.col(key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
