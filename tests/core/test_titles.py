"""English titles, drafts' names and case numbers on hand-made titles."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("title,want", [
    ("「建築基準法施行規則」の改正のページを掲載しました", "建築基準法施行規則"),
    ("（受付終了）食品表示基準の一部改正に関する意見募集について", "食品表示基準の一部改正"),
    ("『「会社法」』について", "会社法"),
    ("省令案  の 公表について", "省令案 の 公表"),
    (" 告示を公表しました。", "告示"),
    ("", ""),
])
def test_subject(spark, title, want):
    from tidemill.functions.titles import subject

    assert spark.createDataFrame([(title,)], "t string").select(subject(F.col("t"))).first()[0] == want


def test_titles(spark):
    from tidemill.functions.rules import Rule
    from tidemill.functions.titles import english_title

    topics = [Rule("Food Labelling Standards", ("食品表示",)), Rule("Response to a Leak", ("漏えい",))]
    safe = [(("MLIT",), "", ("リコール",), "MLIT Update: Recall")]
    rows = [
        ("食品表示基準の一部改正に関する意見募集について", "消費者庁", "Public Comment Open", "Food", "CAA Update: Draft Amendment to Food Labelling Standards"),
        ("食品表示基準の変更案の公表について", "消費者庁", "Public Comment Closed", "Food", "CAA Update: Closed public comment on Draft Revision to Food Labelling Standards"),
        ("個人データの漏えいについて", "PPC", "In Force", "Privacy", "PPC Update: Response to a Leak"),
        ("食品表示を更新しました", "MAFF", "Public Comment Results Published", "Food", "MAFF Public Comment: Food Labelling Standards Updated"),
        ("リコールの届出について", "MLIT", "In Force", "Other", "MLIT Update: Recall"),
        ("告示", "MOJ", "Public Comment Open", "Other", "Public Comment: Regulatory proposal open for comment"),
        ("告示", "MOJ", "In Force", "Courts", "MOJ Update: Regulatory announcement related to Courts"),
        ("告示", "x", "In Force", None, "Japanese Regulatory Update: Regulatory announcement related to Japanese regulatory matters"),
        ("FAQ " + "word " * 40, "金融庁", "In Force", "Other", ("FSA Update: FAQ " + "word " * 40)[:115].rstrip() + "..."),
        (None, "JPX Tokyo Stock Exchange", "Public Comment Open", "Other", "JPX Public Comment: "),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "t string, s string, g string, a string")
    got = [r[0] for r in df.select(english_title(F.col("t"), F.col("s"), F.col("g"), F.col("a"), topics, safe)).collect()]
    assert got == [r[4] for r in rows] and all(len(t) <= 120 for t in got)


def test_drafts_and_cases(spark):
    from tidemill.functions.cases import case_numbers, draft_name, romanised

    df = spark.createDataFrame([("「道路運送法施行規則」の一部を改正する省令(案)に関する意見", "令和元（行ツ）１２、平成30(受)5 平成30(受)5、昭和60(甲)1"), (None, None)], "a string, b string")
    rows = df.select(draft_name(F.col("a")), case_numbers(F.col("b"))).collect()
    assert rows[0][0] == "道路運送法施行規則の一部を改正する省令" and [tuple(c) for c in rows[0][1]] == [("令和元(行ツ)12", 2019, "Gyo-Tsu", 12), ("平成30(受)5", 2018, "Ju", 5)]
    assert rows[1][0] == "" and rows[1][1] == []
    codes = spark.createDataFrame([("ラ",), ("を",), ("甲",), ("",)], "c string")
    assert [r[0] for r in codes.select(romanised(F.col("c"))).collect()] == ["Ra", "Wo", None, None]


def test_longer_tables_score_alike(spark):
    from tidemill.functions.rules import contains_any, keyword_score

    words = [f"w{i:03d}" for i in range(60)]
    df = spark.createDataFrame([("w001 w059 w059",), ("none",), (None,)], "t string")
    got = df.select(contains_any(F.col("t"), words), keyword_score(F.col("t"), [(w, i) for i, w in enumerate(words)] + [("w001", 0.5)])).collect()
    assert [r[1] for r in got] == [60.5, 0.0, 0.0] and [bool(r[0]) for r in got] == [True, False, False]
