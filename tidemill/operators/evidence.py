"""Evidence about documents: who covers what, what is complete, what to look for next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import hash_order


def inverted(notes: DataFrame, note: str, ids: Column) -> DataFrame:
    """(id, notes): the notes that name an id, sorted."""
    rows = notes.select(F.col(note).alias("n"), F.explode(F.array_distinct(ids)).alias("id"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("n")).cast("array<string>"), ",").alias("notes"))


def status_index(packs: DataFrame, key: str) -> DataFrame:
    """A row a key: status of its newest pack, how many instruments are settled, whether it has documents."""
    newest = packs.groupBy(key).agg(F.max_by(F.struct("status", "instruments", "documents"), F.col("made_at")).alias("p"))
    ok = F.size(F.filter("p.instruments", lambda i: i["ok"]))
    return newest.select(key, F.col("p.status").alias("status"), ok.cast("long").alias("ok_instruments"), (F.size("p.documents") > 0).alias("has_documents"))


def covered(run_at: Column, listed: Column, key: Column, verified: Column, days: int = 2) -> Column:
    """Whether a run covers a document: it lists it, or without a list the document was verified in the days before the run."""
    return F.when(F.size(listed) > 0, F.array_contains(listed, key)).otherwise((verified <= run_at) & (verified >= run_at - F.make_interval(days=F.lit(days))))


def recent_or_requested(df: DataFrame, at: Column, since: Column, key: str, requested: DataFrame, complete: Column) -> DataFrame:
    """Documents since a day, or those asked for by name; ``missing`` says what an asked one lacks."""
    asked = requested.select(F.col(key).alias("_k")).distinct()
    rows = df.join(asked, F.col(key) == F.col("_k"), "left").where((at >= since) | F.col("_k").isNotNull())
    return rows.withColumn("missing", F.col("_k").isNotNull() & ~complete).drop("_k")


def mismatches(local: Column, canonical: Column, key: str) -> Column:
    """Places where two lists differ in length or in a key of their elements."""
    n = F.greatest(F.size(local), F.size(canonical))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: ~F.try_element_at(F.transform(local, lambda x: x[key]), i + 1).eqNullSafe(F.try_element_at(F.transform(canonical, lambda x: x[key]), i + 1)))


def shorter_names(name: Column, separators: Sequence[str]) -> Column:
    """A name, then what stands before each separator in turn, without repeats: targets to try in order."""
    return F.array_distinct(F.array(name, *[F.substring_index(name, s, 1) for s in separators]))


def canaries(items: DataFrame, exclude: DataFrame, key: str, defects: Sequence[tuple[str, Column, Column]], field: str, count: int, salt: str) -> DataFrame:
    """Rows with planted defects, to test a reviewer: each defect (name, where it fits, the changed field) claims ``count`` rows.

    Defects claim in turn, rows by hash, none twice and none of ``exclude``; the result depends on the rows alone.
    """
    left = items.join(exclude.select(F.col(key).alias("_x")), F.col(key) == F.col("_x"), "left_anti")
    taken, out = None, None
    for name, fits, changed in defects:
        free = left if taken is None else left.join(taken, F.col(key) == F.col("_t"), "left_anti")
        own = free.where(fits).orderBy(hash_order(F.col(key), f"{salt}:{name}"), key).limit(count)
        rows = own.withColumn(field, changed).withColumn("defect", F.lit(name))
        out = rows if out is None else out.union(rows)
        mine = own.select(F.col(key).alias("_t"))
        taken = mine if taken is None else taken.union(mine)
    return out


def next_action(stage: Column, texts: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, text in texts.items():
        out = F.when(stage == name, text).otherwise(out)
    return out
