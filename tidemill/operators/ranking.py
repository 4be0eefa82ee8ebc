"""Ranks, caps, prefixes and samples, all with a total order: results don't depend on the order of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import own_folder


def numbered(df: DataFrame, *order: Column, value: Column | None = None) -> DataFrame:
    """All rows with ``place`` (from 0, in ``order``, which must end unique) and ``before``, the sum of ``value`` over the places before.

    A range sort puts the rows in order over the partitions and a checkpoint fixes them there. One count and sum a
    partition reach the driver; rows of a partition are numbered where they are.
    """
    own_folder(df.sparkSession)
    rows = df.withColumn("_value", F.lit(0) if value is None else value)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    # the identifier holds the partition above its 33 low bits and the row's place in the partition in them
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    parts = sorted((r["_part"], r["n"], r["s"] or 0) for r in rows.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_value").alias("s")).collect())
    starts, n, total = [F.lit(-1), F.struct(F.lit(0).cast("long"), F.lit(0).cast("long"))], 0, 0
    for part, count, amount in parts:
        starts += [F.lit(part), F.struct(F.lit(n).cast("long"), F.lit(int(total)).cast("long"))]
        n, total = n + count, total + amount
    start = F.element_at(F.create_map(*starts), F.col("_part"))
    rows = rows.withColumn("place", start["col1"] + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    if value is None:
        return rows.drop("_value", "_id", "_part")
    earlier = F.sum("_value").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", start["col2"] + F.coalesce(earlier, F.lit(0))).drop("_value", "_id", "_part")


def ranked(df: DataFrame, lead: Column, *order: Column) -> DataFrame:
    """All rows with a global ``rank`` from 1, largest ``lead`` first (null last), then by ``order`` (which must end unique)."""
    return numbered(df, lead.desc(), *order).withColumn("rank", F.col("place") + 1).drop("place")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows with their ``rank``: each task keeps n, one merges them."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The most frequent values, ties by name."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def whole_days(df: DataFrame, day: str, n: int) -> DataFrame:
    """Rows of the newest days, down to the day of the n-th newest row, none of them cut; no rows if there are n or less.

    Days are counted first (one row a day), so no task sorts all rows.
    """
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count("*").alias("_c"))
    newer = F.sum("_c").over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_c").over(Window.partitionBy())
    keep = days.select(F.col(day).alias("_d"), F.coalesce(newer, F.lit(0)).alias("_before"), total.alias("_all")).where((F.col("_before") < n) & (F.col("_all") > n)).select("_d")
    return df.join(keep, F.col(day) == F.col("_d"), "left_semi")


def round_robin(df: DataFrame, within: list[str], group: str, order: list[Column], per_group: int, most: int) -> DataFrame:
    """In each ``within``: the groups, largest first, give one row in turn, ``per_group`` at most each and ``most`` in all; ``turn`` has the place."""
    own = Window.partitionBy(*within, group)
    rows = df.withColumn("_size", F.count("*").over(own)).withColumn("_k", F.row_number().over(own.orderBy(*order))).where(F.col("_k") <= per_group)
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_k", F.desc("_size"), group))
    return rows.withColumn("turn", place).where(F.col("turn") <= most).drop("_size", "_k")


def capped_head(df: DataFrame, source: str, place: str, head: int, per_source: int) -> DataFrame:
    """In the first ``head`` places (from 1) each source keeps ``per_source`` rows, its others follow them; later places stay. ``new_place`` has the order.

    Every row comes back; only the head is ordered anew, so no task sorts the table.
    """
    inside = F.col(place) <= head
    part = F.when(inside, 0).otherwise(F.col(place))  # a later place is a window of its own
    nth = F.row_number().over(Window.partitionBy(part, source).orderBy(place))
    rows = df.withColumn("_tier", F.when(inside & (nth <= per_source), 0).when(inside, 1)).withColumn("_part", part)
    new = F.row_number().over(Window.partitionBy("_part").orderBy("_tier", place))
    return rows.withColumn("new_place", F.when(inside, new).otherwise(F.col(place)).cast("long")).drop("_tier", "_part")


def budget_prefix(df: DataFrame, cost: str, budget: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The longest prefix (of each ``by``) whose costs, whole numbers of 0 or more, add up to the budget or less; ``spent`` has the sum."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
    rows = numbered(df, *order, value=F.coalesce(F.col(cost), F.lit(0)).cast("long"))
    return rows.withColumn("spent", F.col("before") + F.coalesce(F.col(cost), F.lit(0))).where(F.col("spent") <= budget).drop("place", "before")


def hash_order(key: Column, salt: str) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), key.cast("string")), 256)


def stratified(df: DataFrame, first: list[str], strata: list[str], size: int, key: str, salt: str) -> DataFrame:
    """One row for each value of ``first``, then rows of the largest strata in turn, until ``size``."""
    at = hash_order(F.col(key), salt)
    rows = df.withColumn("_h", at)
    lead = F.row_number().over(Window.partitionBy(*first).orderBy("_h", key))
    rows = rows.withColumn("_lead", F.when(lead == 1, 0).otherwise(1))
    own = Window.partitionBy(*strata)
    rows = rows.withColumn("_n", F.count("*").over(own)).withColumn("_k", F.row_number().over(own.orderBy("_lead", "_h", key)))
    order = ["_lead", "_k", F.desc("_n"), *strata, "_h", key]
    return rows.orderBy(*order).limit(size).drop("_h", "_lead", "_n", "_k")


def risk_sample(df: DataFrame, risk: Column, recent: Column, source: str, size: int, key: str, salt: str) -> DataFrame:
    """Half by recency, risk and hash; the other half one row of each source a round."""
    rows = df.withColumn("_h", hash_order(F.col(key), salt)).withColumn("_risk", risk).withColumn("_recent", recent.cast("int"))
    half = size // 2
    lead = rows.orderBy(F.desc("_recent"), F.desc("_risk"), "_h", key).limit(half)
    rest = rows.join(lead.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    turn = F.row_number().over(Window.partitionBy(source).orderBy("_h", key))
    rest = rest.withColumn("_t", turn).orderBy("_t", source).limit(size - half).drop("_t")
    return lead.withColumn("half", F.lit("risk")).union(rest.withColumn("half", F.lit("spread"))).drop("_h", "_risk", "_recent")
