"""Exact links that ambiguity breaks: one candidate on either side, or none."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import own_folder


def link_unique(left: DataFrame, right: DataFrame, on: Column, left_id: str, right_id: str) -> DataFrame:
    """Pairs that meet ``on`` where each side has no other partner.  ``on`` should hold an equality, so the join is hashed."""
    pairs = left.join(right, on)
    n_left = F.count("*").over(Window.partitionBy(left_id))
    n_right = F.count("*").over(Window.partitionBy(right_id))
    return pairs.withColumn("_l", n_left).withColumn("_r", n_right).where("_l = 1 AND _r = 1").drop("_l", "_r")


def first_after(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_id: str) -> DataFrame:
    """As-of join forward: for each left row the first right row of its key at or after its time (ties: smallest id).

    Both sides go through one window over their union, so a key's rows are sorted once and no pair is made.
    """
    both = left.select("*", F.lit(None).cast(right.schema[right_id].dataType).alias("_hit"), F.col(left_at).alias("_at"), F.lit(0).alias("_side"))
    names = [c for c in left.columns]
    other = right.select(
        *[(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in names],
        F.col(right_id).alias("_hit"), F.col(right_at).alias("_at"), F.lit(1).alias("_side"),
    )
    w = Window.partitionBy(key).orderBy("_at", "_side", "_hit").rowsBetween(0, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("_side") == 1, F.struct("_at", "_hit")), ignorenulls=True).over(w)
    return both.union(other).withColumn("_m", hit).where("_side = 0").select(*names, F.col("_m._hit").alias("hit_id"), F.col("_m._at").alias("hit_at"))


def latest_per_key(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; an aggregate, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r"))
    return newest.select(*key, *[F.col("_r").getField(c).alias(c) for c in rest])


def components(spark: SparkSession, members: DataFrame, item: str, group: str) -> DataFrame:
    """Connected components of items that share groups: (item, component), the smallest item of each.

    Labels travel from items to groups and back, so a large group costs its size, not its pairs; every
    round is checkpointed in ``spark.checkpoint.dir`` and the rounds end when no label changes.
    """
    edges = members.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i IS NOT NULL AND g IS NOT NULL").distinct()
    own_folder(spark)
    edges = edges.checkpoint()
    labels = edges.select("i").distinct().select("i", F.col("i").alias("label")).checkpoint()
    while True:
        of_group = edges.join(labels, "i").groupBy("g").agg(F.min("label").alias("low"))
        new = edges.join(of_group, "g").groupBy("i").agg(F.min("low").alias("low")).join(labels, "i")
        new = new.select("i", F.least("low", "label").alias("label"), F.col("label").alias("old")).checkpoint()
        # labels that have a smaller label themselves; that of a finished component, however large, is not among them
        moved = new.where("label < i").select(F.col("i").alias("j"), F.col("label").alias("to"))
        new = new.join(moved, F.col("label") == F.col("j"), "left").select("i", F.coalesce("to", "label").alias("label"), "old").checkpoint()
        labels, changed = new.select("i", "label"), new.where("label <> old").limit(1).count()
        if not changed:
            return labels.select(F.col("i").alias(item), F.col("label").alias("component"))


def fingerprints(components_: DataFrame, rows: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """SHA-256 of each component's rows, a line each, in the order of their ids.

    Spark sorts a component's lines and a task hashes them as they come: no component is ever held whole.
    """
    line = F.concat_ws("|", F.col(item).cast("string"), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    lines = components_.join(rows, item).select("component", F.col(item).alias("_i"), line.alias("_line"))
    lines = lines.repartition("component").sortWithinPartitions("component", "_i", "_line")
    schema = T.StructType([lines.schema["component"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["component", "fingerprint"], None
        now, sha = None, None
        for batch in batches:
            kinds, done = (batch.column(0).type, pa.string()), []
            for component, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is None or component != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = component, hashlib.sha256(text.encode())
                else:
                    sha.update(b"\n" + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kinds[0]), pa.array([sha.hexdigest()])], names=names)

    return lines.mapInArrow(run, schema)
