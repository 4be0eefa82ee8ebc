"""Signs of stage, impact and relevance on titles."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("title,kind,want", [
    ("○○法施行令の一部を改正する政令案に対する意見募集について", "rss", "Public Comment Open"),
    ("意見募集の結果について", "rss", "Public Comment Results Published"),
    ("評価結果（案）についての意見募集", "public_comment_rss", "Public Comment Open"),
    ("審査結果について", "rss", "Government Announcement"),
    ("審査結果について", "public_comment_html", "Public Comment Results Published"),
    ("受付終了 指針案", "rss", "Public Comment Closed"),
    ("改正法が施行されました", "rss", "In Force"),
    ("政令の施行期日", "rss", "Scheduled to Take Effect"),
    ("省令を公布", "rss", "Promulgated"),
    ("特例法が成立", "rss", "Enacted"),
    ("法律案を国会に提出", "rss", "Bill Submitted"),
    ("ガイドライン（案）", "rss", "Draft Guideline"),
])
def test_stage(spark, title, kind, want):
    from tidemill.plans.legal_notices import stage

    assert spark.createDataFrame([(title, kind)], "t string, k string").select(stage(F.col("t"), F.col("k"))).first()[0] == want


def test_scores_count_repeats(spark):
    from tidemill.plans import legal_notices as N

    score = lambda t, k="rss": spark.createDataFrame([(t, k)], "t string, k string").select(N.relevance(F.col("t"), F.col("k"))).first()[0]
    assert len(N.MORE_STRONG) == 69 and len(set(N.MORE_STRONG)) == 60
    assert score("省令") == 5 + 2 * 5  # once among the strong, twice among the further ones
    assert score("採用") == -8 and score("報告") == 1
    assert score("何もない", "public_comment_rss") == 4


def test_published_order(spark):
    from tidemill.plans.legal_notices import publish

    rows = [
        (0, "a", "改正政令の公布", "x", "rss", "2024-01-30T00:00:00Z", None),
        (1, "b", "改正政令の公布", "x", "rss", "2024-01-30T00:00:00Z", None),
        (2, "c", "採用情報", "x", "rss", "2024-01-31T00:00:00Z", None),
        (3, "d", "入札に関する法律", "x", "rss", "2023-01-31T00:00:00Z", None),
        (4, "e", "漁業の意見募集", "x", "public_comment_rss", "", None),
        (5, "f", "最高裁判決", "x", "court_html", "2024-01-31T00:00:00Z", "Court Decision"),
        (6, "g", "何でもない", "x", "rss", "2024-01-31T00:00:00Z", None),
    ]
    df = spark.createDataFrame(rows, "ord long, id string, title_ja string, source_name string, source_type string, published_at string, stage_hint string")
    got = publish(df, F.lit("2024-02-01 00:00:00").cast("timestamp")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    ids = [r["id"] for r in got]
    assert ids.index("a") + 1 == ids.index("b") and "c" not in ids and "g" not in ids and {"d", "e", "f"} <= set(ids)
    by = {r["id"]: r for r in got}
    assert by["f"]["stage"] == "Court Decision" and by["e"]["impact_level"] == "Low" and by["e"]["stage"] == "Public Comment Open"
