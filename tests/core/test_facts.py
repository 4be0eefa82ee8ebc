"""Dates and numbers of texts in three languages."""

import pytest
from pyspark.sql import functions as F


def facts(spark, reader, text):
    found = spark.createDataFrame([(text,)], "t string").select(reader(F.col("t")).alias("f")).first()["f"]
    return sorted(((d["y"] or 0, d["m"], d["d"]) for d in found["dates"])), list(found["numbers"])


@pytest.mark.parametrize("text,dates,numbers", [
    ("From 2024-04-01, on 1 and 5 May, in June to July 2025.", [(0, 5, 1), (0, 5, 5), (2024, 4, 1), (2025, 6, 0), (2025, 7, 0)], [2024, 2025]),
    ("March 3, 2024 or 4 April, 2025; may 2026; by August", [(0, 8, 0), (2024, 3, 3), (2025, 4, 4), (2026, 5, 0)], [2024, 2025, 2026]),
    ("Two of 1,200 firms (iv) paid 3.5 million, twice; a Dozen", [], [2, 3, 4, 12, 1200]),
    (None, [], []),
])
def test_english(spark, text, dates, numbers):
    from tidemill.functions.facts import english_facts

    assert facts(spark, english_facts, text) == (dates, numbers)


@pytest.mark.parametrize("text,dates,numbers", [
    ("令和六年四月に。令和6年4月1日から施行", [(2024, 4, 1)], [4, 2024]),
    ("令和元年5月1日、5月3日から7日、2024年6月～8月", [(0, 5, 3), (0, 5, 7), (2019, 5, 1), (2024, 6, 0), (2024, 8, 0)], [2019, 2024]),
    ("三百二十一件、両院、3万人、2割、第一、二〇名", [], [20, 321, 30000]),
    ("10月中に1,500円", [(0, 10, 0)], [1500]),
])
def test_local(spark, text, dates, numbers):
    from tidemill.functions.facts import local_facts

    assert facts(spark, local_facts, text) == (dates, numbers)


def test_support(spark):
    from tidemill.functions.facts import english_facts, fact_places, local_facts, unsupported_facts

    df = spark.createDataFrame([("On 1 April 2024, 12 firms; by May 2025", "2024年4月1日に12社と15社、5月2日、2025年5月、2026年6月")], "e string, l string")
    found = unsupported_facts(english_facts(F.col("e")), local_facts(F.col("l")))
    row = df.select(found.alias("f"), fact_places(found, F.col("l"), 2, 6).alias("p")).first()
    assert row["f"] == ["date 05-02", "date 2026-06", "number 15", "number 2026"]
    assert [tuple(p) for p in row["p"]][2] == ("number 15", "社と15社、")


def test_pages(spark):
    from tidemill.operators.pages import page_excerpts, substance

    pages = [(1, 1, "表紙 " + "a" * 500), (1, 2, "目次 施行期日 第1条 " + "b" * 500), (1, 3, "c" * 500), (1, 4, "施行期日 経過措置 第1条 第二条 " + "d" * 500), (1, 5, "届出 " + "e" * 500), (2, 2, "second"), (2, 1, " first \n page "), (2, 3, " "), (3, 1, None)]
    df = spark.createDataFrame(pages, "doc int, n int, t string")
    scores = [r[0] for r in spark.createDataFrame([(p[2],) for p in pages[:5]], "t string").select(substance(F.col("t"))).collect()]
    assert scores == [0, -4, 0, 8, 3]
    got = {r["doc"]: r["excerpt"] for r in page_excerpts(df, "doc", "n", "t", 1600).collect()}
    assert got[2] == "first page second" and set(got) == {1, 2}
    assert [w for w in ("表紙", "目次", "c" * 90, "経過措置", "届出") if w in got[1]] == ["表紙", "経過措置", "届出"] and len(got[1]) <= 1600
    assert got[1].startswith("[page 1; excerpt] 表紙") and "[page 4; excerpt] 施行期日" in got[1]
