"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, placed_by

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(spark: SparkSession, sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """One row a source with its share of the total.

    ``sizes`` has ``source`` and ``source_size`` (a row per source).  Sources in
    code-point order, null last, weigh ``weights`` in turn.  A target stops at
    ``most`` times its source's size and the excess is shared again by weight:
    sources fill up in the order of their cap for each unit of weight, so one
    pass over them in that order finds all that stop, without iterating.  Both orders are range sorts:
    there may be as many sources as hosts.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = _before(placed_by(spark, sizes.select("source", "source_size"), *by_name), F.lit(1).cast("long"), "n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("n", "at", "part")
    rows = placed_by(spark, rows, F.col("cap") / F.col("weight"), *by_name)
    rows = _before(_before(rows, F.col("cap"), "full"), F.col("weight"), "filled")
    whole = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["total"]) - F.col("full")) / (F.lit(whole["weight"]) - F.col("filled"))
    # where this source, and so all after it, would get at most its cap; it is largest at the first such source
    found = rows.where(level <= F.col("cap") / F.col("weight")).agg(F.max(level).alias("level")).first()["level"]
    share = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("weight"))
    return rows.select("source", "source_size", share.alias("target"))


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of ``at``: within a partition, and of whole partitions (one row each)."""
    parts = rows.groupBy(F.col("part").alias("p")).agg(F.sum(value).alias("v"))
    earlier = F.sum("v").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    parts = parts.select("p", F.coalesce(earlier, F.lit(0)).alias("v"))
    own = F.sum(value).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(name, F.coalesce(own, F.lit(0))).join(parts, F.col("part") == F.col("p"))
    return rows.withColumn(name, F.col(name) + F.col("v")).drop("p", "v")


def mix(spark: SparkSession, docs: DataFrame, key: str, source: str, size: str, weights: list[int], most: int = 3, seed: str = "mix", tie: str | None = None) -> DataFrame:
    """How many words the mix takes of every row.

    Returns ``docs``'s columns plus ``mix_source_size``, ``mix_target`` and
    ``mix_taken``.  Rows of a source lie in the order of a hash of their key and
    the seed.  Whole epochs take every row; in the last, rows are taken while the
    sum of the sizes before them stays below the budget (the target, rounded), and
    the row at the cut gives only what is missing: a source takes its budget exactly.
    All rows are range-sorted by source and hash; prefix sums have two levels, partitions within a source and rows
    within a partition, so no task holds a source, nor a key that many rows have.

    Null sizes count 0; a null source is a source of its own, in the last place;
    a null key hashes as the word "null".  Rows with the same key tie: they stay
    neighbours in the order (by size), and as such rows are alike to the mix, which of them the
    cut falls on doesn't show in the result.  Where it does, ``tie`` names a column that orders them.  An empty table gives an empty result.
    Extra columns pass through, but for those named like a result, which are replaced; pass narrow rows, without texts.
    """
    rest = [c for c in docs.columns if c.lower() not in ("mix_source_size", "mix_target", "mix_taken")]
    rows = docs.select(
        F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(":" + seed))).alias("hash"),
        (F.lit(0) if tie is None else F.col(f"`{tie}`")).alias("tie"),
    )
    rows = placed_by(spark, cut(spark, rows), "source", "hash", "size", "tie")  # the range sort reads its input twice
    parts = cut(spark, rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    per_source = targets(spark, parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    per_source = per_source.select("source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "source_size", "target", "epochs", "rest", "part_before")
    in_part = Window.partitionBy("source", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row_before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("part_before") - F.col("row_before")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("epochs") * F.col("size") + left).alias("mix_taken"))
