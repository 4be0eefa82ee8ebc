"""Evidence operators."""

import datetime as dt

from pyspark.sql import functions as F


def test_status_and_cover(spark):
    from tidemill.operators.evidence import covered, mismatches, shorter_names, status_index

    packs = spark.createDataFrame(
        [("a", "ok", [(True,), (False,)], ["d"], 1), ("a", "bad", [(True,)], [], 2), ("b", "ok", [], ["x"], 1)],
        "seed string, status string, instruments array<struct<ok: boolean>>, documents array<string>, made_at int",
    )
    assert sorted(tuple(r) for r in status_index(packs, "seed").collect()) == [("a", "bad", 1, False), ("b", "ok", 0, True)]
    runs = spark.createDataFrame(
        [(dt.datetime(2024, 1, 5), ["x"], "x", dt.datetime(2020, 1, 1)), (dt.datetime(2024, 1, 5), ["x"], "y", dt.datetime(2024, 1, 4)), (dt.datetime(2024, 1, 5), [], "y", dt.datetime(2024, 1, 4)), (dt.datetime(2024, 1, 5), [], "y", dt.datetime(2024, 1, 6)), (dt.datetime(2024, 1, 5), [], "y", dt.datetime(2024, 1, 1))],
        "at timestamp, listed array<string>, k string, v timestamp",
    )
    assert [r[0] for r in runs.select(covered(F.col("at"), F.col("listed"), F.col("k"), F.col("v"))).collect()] == [True, False, True, False, False]
    lists = spark.createDataFrame([([("a",), ("b",)], [("a",), ("c",), ("d",)]), ([], [])], "l array<struct<k: string>>, c array<struct<k: string>>")
    assert [r[0] for r in lists.select(mismatches(F.col("l"), F.col("c"), "k")).collect()] == [[1, 2], []]
    assert spark.range(1).select(shorter_names(F.lit("a-b.c"), [".", "-", "!"])).first()[0] == ["a-b.c", "a-b", "a"]
