"""Records of several kinds linked into timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates_once(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left side has one candidate alone, and no right side is claimed twice: else none of them."""
    n = F.count("*").over(Window.partitionBy(left))
    m = F.count("*").over(Window.partitionBy(right))
    return pairs.withColumn("_n", n).withColumn("_m", m).where("_n = 1 AND _m = 1").drop("_n", "_m")


def link_drafts(drafts: DataFrame, acts: DataFrame, years: int = 1, days: int = 400) -> DataFrame:
    """Drafts to acts of the same name (each name unique among drafts), years at most ``years`` and days at most ``days`` apart."""
    once = drafts.withColumn("_c", F.count("*").over(Window.partitionBy("name"))).where("_c = 1").drop("_c")
    a = acts.select(F.col("name").alias("a_name"), F.col("id").alias("act_id"), F.col("day").alias("a_day"))
    near = (F.abs(F.year("day") - F.year("a_day")) <= years) & (F.abs(F.datediff("day", "a_day")) <= days)
    return candidates_once(once.join(a, (F.col("name") == F.col("a_name")) & near).select("id", "act_id"), "id", "act_id")


def link_consultations(consultations: DataFrame, acts: DataFrame, days: int = 365) -> DataFrame:
    """Consultations to the one act of their name that came within ``days`` days after; the name must be unique on both sides."""
    unique = lambda df: df.withColumn("_c", F.count("*").over(Window.partitionBy("name"))).where("_c = 1").drop("_c")
    a = unique(acts).select(F.col("name").alias("a_name"), F.col("id").alias("act_id"), F.col("day").alias("a_day"))
    gap = F.datediff("a_day", "day")
    return unique(consultations).join(a, (F.col("name") == F.col("a_name")) & (gap > 0) & (gap <= days)).select("id", "act_id", gap.alias("days"))


def ordered_events(events: DataFrame, key: str, day: str, rank: str, anchor: Column) -> DataFrame:
    """Events with their place in the timeline: undated ones stand at the day of the anchor rows, else at the earliest."""
    w = Window.partitionBy(key)
    at = F.coalesce(F.col(day), F.min(F.when(anchor, F.col(day))).over(w), F.min(day).over(w))
    return events.withColumn("_at", at).withColumn("place", F.row_number().over(w.orderBy(F.asc_nulls_last("_at"), rank, "id")).cast("long")).drop("_at")


def with_several(events: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Timelines of ``least`` events or more."""
    return events.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n")
