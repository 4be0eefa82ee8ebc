"""Deduplication and idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ascending ``order`` (nulls first), which must end unique; an aggregate, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*[F.col(c) if c in key else F.col("_r").getField(c).alias(c) for c in df.columns])


def append_unseen(history: DataFrame, batch: DataFrame, key: str, url: str, by_url: Column, order: str) -> DataFrame:
    """Rows of ``batch`` that ``history`` doesn't have: neither by key nor, where ``by_url`` holds, by URL; the first of each key.

    Both look-ups are anti joins on hashed keys, so a batch is appended again without effect.
    """
    first = first_per_key(batch.withColumn("_by_url", by_url), [key], [F.col(order)])
    known = history.select(F.col(key).alias("_k")).distinct()
    urls = history.select(F.col(url).alias("_u")).distinct()
    fresh = first.join(known, F.col(key) == F.col("_k"), "left_anti")
    return fresh.join(urls, F.col("_by_url") & (F.col(url) == F.col("_u")), "left_anti").drop("_by_url")


def unique_titles(df: DataFrame, title: str, suffix: Column, order: list[Column]) -> DataFrame:
    """Titles that several rows share get a suffix; others stay."""
    n = F.count("*").over(Window.partitionBy(title))
    return df.withColumn(title, F.when(n > 1, F.concat(F.col(title), F.lit(" ("), suffix, F.lit(")"))).otherwise(F.col(title)))


def only_once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
