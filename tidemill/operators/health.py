"""Source health: reports checked, streaks kept, gates judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("success", "error")


def report_problems(report: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_key, problem) of a fetch report: missing and unknown sources, duplicates, bad fields."""
    n = report.groupBy("source_key").agg(F.count("*").alias("n"))
    known = sources.select(F.col("source_key").alias("k"))
    both = n.join(known, F.col("source_key") == F.col("k"), "full_outer")
    keys = both.select(
        F.coalesce("source_key", "k").alias("source_key"),
        F.explode(F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("k").isNull(), F.lit("unknown")), F.when(F.col("n") > 1, F.lit("duplicate"))))).alias("problem"),
    )
    bad = report.select("source_key", F.explode(F.array_compact(F.array(
        F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), F.lit("status")),
        F.when(F.coalesce(F.col("fetched_count") < 0, F.lit(True)), F.lit("fetched_count")),
        F.when(F.coalesce(F.col("new_count") < 0, F.lit(True)), F.lit("new_count")),
        F.when((F.col("status") == "error") & (F.coalesce("error_type", F.lit("")) == ""), F.lit("error_type")),
    ))).alias("problem"))
    return keys.union(bad).distinct()


def next_state(report: DataFrame, previous: DataFrame, checked_at: str) -> DataFrame:
    """Streaks after one run: zero rows and errors count up, a healthy run clears both and stamps a recovery; sources without a state begin at 0."""
    p = previous.select(F.col("source_key").alias("k"), F.col("consecutive_zero_runs").alias("z"), F.col("consecutive_error_runs").alias("e"), F.col("last_problem_at").alias("pa"), F.col("last_recovered_at").alias("ra"))
    rows = report.join(p, F.col("source_key") == F.col("k"), "left")
    status = F.when(F.col("status") == "error", "error").when(F.col("fetched_count") == 0, "zero").otherwise("healthy")
    rows = rows.select("source_key", status.alias("s"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("z", "e")], "pa", "ra")
    was_bad = (F.col("z") > 0) | (F.col("e") > 0)
    return rows.select(
        "source_key",
        F.when(F.col("s") == "zero", F.col("z") + 1).otherwise(0).cast("long").alias("consecutive_zero_runs"),
        F.when(F.col("s") == "error", F.col("e") + 1).otherwise(0).cast("long").alias("consecutive_error_runs"),
        F.col("s").alias("last_status"),
        F.when(F.col("s") != "healthy", F.lit(checked_at)).otherwise(F.col("pa")).alias("last_problem_at"),
        F.when((F.col("s") == "healthy") & was_bad, F.lit(checked_at)).otherwise(F.col("ra")).alias("last_recovered_at"),
    )


def gate(state: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """Sources whose streak reaches ``most``: failures where they are required, else warnings."""
    rows = state.join(sources.select(F.col("source_key").alias("k"), "required"), F.col("source_key") == F.col("k"))
    worst = F.greatest("consecutive_zero_runs", "consecutive_error_runs")
    return rows.where(worst >= most).select("source_key", worst.alias("streak"), F.when(F.col("required"), "failure").otherwise("warning").alias("verdict"))


def totals(state: DataFrame) -> DataFrame:
    s = F.col("last_status")
    return state.agg(F.count_if(s == "healthy").alias("healthy"), F.count_if(s == "zero").alias("warning"), F.count_if(s == "error").alias("error"), (F.count_if(s == "healthy") == 0).alias("all_failed"))
