"""Column functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def values(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_a_word_listed_twice_counts_twice(spark):
    from tidemill.functions.rules import keyword_score

    assert values(spark, ["notice of change", "none"], keyword_score(F.col("t"), [("notice", 3), ("change", 2), ("notice", 3)])) == [8.0, 0.0]


def test_first_rule_wins_and_gates_hold(spark):
    from tidemill.functions.rules import Rule, first_match

    rules = [Rule("a", ("x", "y"), every=True), Rule("b", ("x",), gates=("g",)), Rule("c", ("x",))]
    got = values(spark, [("xy", "h"), ("x", "g"), ("x", "h"), ("z", "g"), (None, "g")], first_match(F.col("t"), rules, "other", F.col("g")), "t string, g string")
    assert got == ["a", "b", "c", "other", "other"]


def test_exclusion_is_lifted_by_rescue(spark):
    from tidemill.functions.rules import excluded_unless_rescued

    assert values(spark, ["noise", "noise but strong", "fine"], excluded_unless_rescued(F.col("t"), ["noise"], ["strong"])) == [True, False, False]


@pytest.mark.parametrize("text,want", [("2024-02-03", dt.date(2024, 2, 3)), ("2024-2-3", None), ("2024-02-30", None), ("", None), ("2024-02-03T00:00", None)])
def test_strict_dates(spark, text, want):
    from tidemill.functions.dates import strict_date

    assert values(spark, [text], strict_date(F.col("t"))) == [want]


def test_any_date(spark):
    from tidemill.functions.dates import any_date

    got = values(spark, ["2024-02-03T10:00:00Z", "20240203", "2024/2/3", "令和6年2月3日", "令和元年5月1日", "令和6年13月3日", "soon"], any_date(F.col("t")))
    day = dt.date(2024, 2, 3)
    assert got == [day, day, day, day, dt.date(2019, 5, 1), None, None]


def test_a_date_closes_at_the_next_midnight_of_its_zone(spark):
    from tidemill.functions.dates import closes_at, last_day, resolve_stage

    rows = ["2024-02-03", "2024-02-03T12:00:00", "2024-02-03T12:00:00Z", "never", ""]
    assert values(spark, rows, F.date_format(closes_at(F.col("t")), "yyyy-MM-dd HH:mm")) == ["2024-02-03 15:00", "2024-02-03 03:00", "2024-02-03 12:00", None, None]
    assert values(spark, rows[:1], last_day(F.col("t"))) == [dt.date(2024, 2, 3)]
    for now, want in (("2024-02-03 14:59:59", "Open for Comment"), ("2024-02-03 15:00:00", "Closed")):
        assert values(spark, rows[:1], resolve_stage(F.lit("Open for Comment"), F.col("t"), F.lit(now).cast("timestamp"))) == [want]


def test_weeks_and_periods(spark):
    from tidemill.functions.dates import newly_seen, period_pair, week_monday, week_slug

    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 3), dt.date(2021, 1, 4)]
    assert values(spark, days, week_slug(F.col("t")), "t date") == ["2020-w53", "2020-w53", "2021-w01"]
    assert values(spark, days, week_monday(F.col("t")), "t date") == [dt.date(2020, 12, 28), dt.date(2020, 12, 28), dt.date(2021, 1, 4)]
    got = spark.range(1).select(*period_pair("monthly", F.lit("2024-03-31").cast("date"))).first()
    assert tuple(got) == (dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert values(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2024, 1, 8), None], newly_seen(F.col("t"), F.lit("2024-01-07").cast("date")), "t date") == [True, True, False, False]


def test_text(spark):
    from tidemill.functions import text as X

    assert values(spark, ["a: 1; b: x: y; a: 2; c"], X.fields(F.col("t"))) == [{"b": "x: y", "a": "2"}]
    assert values(spark, ["=1+1", ' -"x', "ok", None], X.csv_cell(F.col("t"))) == ['"\'=1+1"', '"\' -""x"', '"ok"', '""']
    assert values(spark, ["on 2024/3/5 and 2024年12月31日, 2024/13/1"], X.iso_dates(F.col("t"))) == ["on 2024-03-05 and 2024-12-31, 2024/13/1"]
    assert values(spark, ["https://u:p@h/", "http://h:80/x?y", "ftp://h", "https://h/a b"], X.safe_url(F.col("t"))) == [None, "http://h:80/x?y", None, None]
    assert values(spark, ["http://U@EX.com:1/x", "none"], X.host(F.col("t"))) == ["ex.com", ""]
    assert values(spark, ["from A: the part B: rest", "B: A:"], X.between_labels(F.col("t"), "A:", "B:")) == ["the part", None]
    assert values(spark, ["Ａ・ B「c」", None], X.title_key(F.col("t"))) == ["abc", None]
    assert values(spark, ["&lt;b&gt;x&lt;/b&gt; &amp; y"], X.clean_markup(F.col("t"))) == ["x & y"]
    folded = values(spark, ["é" * 80], X.folded_ics(F.col("t")))[0]
    assert all(len(x.encode()) <= 75 for x in folded) and "".join(folded).replace(" ", "") == "é" * 80
    assert values(spark, ["12 of 2012 and 7"], F.array_join(X.unsupported_numbers(F.col("t"), F.lit("2012")), ",")) == ["7"]
    assert values(spark, ["a,b;c\nd"], X.escape_ics(F.col("t"))) == ["a\\,b\\;c\\nd"]


def test_identities(spark):
    import hashlib

    from tidemill.functions.hashing import blob_hash, cost_bound, stable_id

    rows = [("e", "u"), (None, "u"), ("", ""), (None, None)]
    got = values(spark, rows, stable_id("raw-", F.col("e"), F.col("u"), [F.col("u")]), "e string, u string")
    want = lambda s: "raw-" + hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got[:2] == [want("event:e"), want("url:u")] and got[2] == got[3]
    assert values(spark, ["a\r\nb"], blob_hash(F.col("t"))) == [hashlib.sha1(b"blob 3\0a\nb").hexdigest()]
    assert abs(values(spark, [(1000, 500)], cost_bound(F.col("a"), F.col("b"), 3.0, 15.0, batch=True), "a int, b int")[0] - (1000 * 1.1 * 3 + 500 * 15) / 1e6 / 2) < 1e-12


def test_numerals_differ_on_purpose(spark):
    from tidemill.functions.numerals import free_number, short_number, strict_number

    rows = ["三百二十一", "二〇二四", "千五", "十", "12", "x", None]
    assert values(spark, rows, short_number("t")) == [321, None, None, 10, 12, None, None]
    assert values(spark, rows, free_number("t")) == [321, 2024, 1005, 10, 12, None, None]
    assert values(spark, rows, strict_number("t"))[:4] == [321, 2024, 1005, 10]
