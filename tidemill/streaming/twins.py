"""Streaming forms of ingest, streaks and weekly counts.

State is keyed and bounded: seen identities expire with the watermark, a
streak is one row a key.  Checkpoints and outputs belong in shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def first_seen(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Rows whose key did not come before, within the time that rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def weekly(stream: DataFrame, at: str, kind: str, late: str = "7 days") -> DataFrame:
    """Counts by week from Monday and kind; a week is closed once no row can be late for it."""
    week = F.window(at, "7 days", "7 days", "4 days")
    return stream.withWatermark(at, late).groupBy(week, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), kind, "n")


STREAK = "key string, n_bad long, last_at timestamp"


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Only the bad rows after the last good one count; of a batch no more than those is kept, whatever the order of the rows."""
    n, _ = state.get if state.exists else (0, None)
    good, last, later = None, None, []
    for batch in batches:
        order = pd.MultiIndex.from_frame(batch[["at", "id"]])
        last = max(order.max(), last) if last else order.max()
        fine = order[~batch["bad"].to_numpy(bool)]
        if len(fine) and (good is None or fine.max() > good):
            good = fine.max()
            later = [x[x > good] for x in later]
        bad = order[batch["bad"].to_numpy(bool)]
        later.append(bad if good is None else bad[bad > good])
    n = (n if good is None else 0) + sum(map(len, later))
    state.update((n, last[0]))
    yield pd.DataFrame({"key": [key[0]], "n_bad": [n], "last_at": [last[0]]})


def streak_updates(stream: DataFrame, key: str, at: str, order: str, bad: str) -> DataFrame:
    """The running streak of each key after every batch; rows of a batch count in the order of time and id."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(order).alias("id"), F.expr(bad).alias("bad"))
    return rows.groupBy("key").applyInPandasWithState(_streak, STREAK, "n_bad long, last_at timestamp", "update", "NoTimeout")


def run_once(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the stream, into Parquet; a second call reads only what is new."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
