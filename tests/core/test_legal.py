"""Legal text functions."""

from pyspark.sql import functions as F


def columns(spark, texts, *made):
    return [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*made).collect()]


def test_law_numbers_of_one_law_are_equal(spark):
    from tidemill.functions.legal import law_number_key

    texts = ["令和八年厚生労働省令第百二十一号", "令和８年 七月三一日 厚生労働省令第一二一号", "令和元年法律第五号", "告示 第１号", "", None, "令和x年法律第五号"]
    a, b, first, other, empty, none, odd = (r[0] for r in columns(spark, texts, law_number_key(F.col("t"))))
    assert tuple(a) == tuple(b) == ("令和", 8, "厚生労働省令", 121, None)
    assert first["year"] == 1 and tuple(other) == (None, None, None, None, "告示第1号")
    assert tuple(empty) == tuple(none) == (None,) * 5 and odd["other"] == "令和x年法律第五号"


def test_articles_and_sentences(spark):
    from tidemill.functions.legal import article_refs, sentence_list

    texts = ["第八十八条の三及び第１２条、第十二条", "第千二百三条、第二〇条、第1二条、第百条の2", None, "第一二条の十"]
    assert [r[0] for r in columns(spark, texts, article_refs(F.col("t")))] == [["第12条", "第88条の3"], ["第100条の2", "第1203条"], [], ["第12条の10"]]
    texts = ["甲（乙をいう。）とする。丙「丁。」\n（戊。己。", None, "）。（（。）。）。a\n\n。", " x 。", "（"]
    assert [r[0] for r in columns(spark, texts, sentence_list("t"))] == [["甲（乙をいう。）とする。", "丙「丁。」", "（戊。己。"], [], ["）。", "（（。）。）。", "a", "。"], ["x 。"], ["（"]]


def test_instants(spark):
    from tidemill.functions.legal import instants_in_jst

    texts = ["a 2026-01-01T00:00 b", "2026-13-01T00:00:00Z", "2026-01-01T23:30:15.25-0530,", "2026-01-01T00:00:00+25:00", "x2026-01-01T00:00:00Z", "12026-01-01T00:00Z", "", None]
    want = ["a 2026-01-01 00:00 JST b", "2026-13-01T00:00:00Z", "2026-01-02 14:00:15 JST,", "2026-01-01T00:00:00+25:00", "x2026-01-01 09:00 JST", "12026-01-01T00:00Z", "", None]
    assert [r[0] for r in columns(spark, texts, instants_in_jst(F.col("t")))] == want


def test_columns(spark):
    from tidemill.functions import legal as L

    df = spark.createDataFrame([("令和八年法律第三号", "締切 2026-09-29T23:59:00+09:00, 2026-01-01T00:00:30Z"), (None, None)], "a string, b string")
    rows = df.select(L.law_number_key(F.col("a")).alias("k"), L.instants_in_jst(F.col("b")).alias("t"), L.article_refs(F.col("a")).alias("r"), L.sentence_list("a").alias("s")).collect()
    assert (rows[0]["k"]["year"], rows[0]["k"]["number"], rows[0]["t"]) == (8, 3, "締切 2026-09-29 23:59 JST, 2026-01-01 09:00:30 JST")
    assert rows[1]["t"] is None and rows[1]["r"] == [] and rows[1]["s"] == []
    texts = spark.createDataFrame([("it is risky",), ("it is not risky",), ("not here. It is risky",), ("fine",)], "t string")
    assert [r[0] for r in texts.select(L.unnegated(F.col("t"), "risky", r"\bnot\b")).collect()] == [True, False, True, False]
    assert [r[0] for r in texts.select(L.first_kind(F.col("t"), [("neg", "not"), ("pos", "risky")])).collect()] == ["pos", "neg", "neg", None]
