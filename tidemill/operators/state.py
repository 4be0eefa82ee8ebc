"""Streaks, periods, cohorts and other keyed state in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(df: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """Adds ``streak``: how many rows of the key in a row, up to this one, were bad."""
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_run", run).withColumn("_bad", bad.cast("int"))
    inside = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum("_bad").over(inside)).drop("_run", "_bad")


def carried(df: DataFrame, key: list[str], order: list[Column], value: Column) -> Column:
    """The last value that isn't null, up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def period_change(df: DataFrame, at: Column, bounds: tuple[Column, Column, Column], keys: list[str]) -> DataFrame:
    """Counts of a period and of the one before, and the change in percent (null from zero), in one pass."""
    earlier, start, end = bounds
    rows = df.where((at >= earlier) & (at < end))
    out = rows.groupBy(*keys).agg(F.count(F.when(at >= start, 1)).alias("now"), F.count(F.when(at < start, 1)).alias("before"))
    return out.withColumn("change_pct", F.when(F.col("before") > 0, F.round((F.col("now") - F.col("before")) * 100.0 / F.col("before"), 4)))


def cohort_matrix(df: DataFrame, day: Column, kind: str, kinds: list[str], last: Column, days: int) -> DataFrame:
    """A row for each of the last ``days`` days, a column for each kind, zero where nothing happened."""
    spine = df.sparkSession.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    rows = df.select(day.alias("d"), F.col(kind).alias("k")).where(F.col("d").isNotNull())
    counts = rows.groupBy("d").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in kinds])
    return spine.join(counts, F.col("day") == F.col("d"), "left").select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def shards(df: DataFrame, period: Column) -> DataFrame:
    """Rows a period and in all, in one pass: the manifest."""
    return df.select(period.alias("period")).rollup("period").agg(F.count("*").alias("n")).select(F.coalesce("period", F.lit("total")).alias("period"), "n")


def mode(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, the smallest of equals; both steps are combined before their shuffle."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m"))
    return best.select(*key, F.col("m").getField(value).alias(value), F.col("m.n").alias("n"))
