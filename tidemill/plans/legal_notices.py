"""Policy for legal and regulatory notices in Japanese: what scores, what is noise, which stage and impact a title has.

Area tables are larger and belong to a deployment: pass them as rules (:func:`load_rules`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rule, above_floor, contains_any, excluded_unless_rescued, first_match, keyword_score, recency_penalty, trusted_hint
from ..operators.ranking import ranked

# ---- Fixed values: results depend on each entry, on its order and on entries that occur twice.
STRONG = (
    "改正", "施行", "公布", "法律", "政令", "省令", "告示", "通達",
    "意見募集", "パブリックコメント", "パブリック・コメント",
)
MODERATE = (
    "指針", "ガイドライン", "Q&A", "Ｑ＆Ａ", "FAQ", "案", "概要", "義務",
    "規制", "届出", "許可", "認可", "監督", "考え方",
)
TOPICAL = (
    "個人情報", "ＡＩ", "AI", "金融", "労働", "フリーランス", "下請", "表示",
    "広告", "景品", "サイバー", "エネルギー", "環境", "外国為替", "外為",
    "経済安全保障",
)
WEAK = ("報告",)
MORE_STRONG = (
    "法律案", "改正案", "政令", "省令", "告示", "通達", "ガイドライン", "指針", "Q&A",
    "パブリックコメント", "意見募集", "意見募集結果", "施行", "公布", "閣議決定",
    "認定制度", "許認可", "行政処分", "措置命令", "勧告", "厳重注意", "検疫",
    "輸出入規制", "食品安全", "建築基準", "都市計画", "道路運送車両", "保安基準",
    "法改正", "命令", "勧告", "行政処分", "注意喚起", "ガイドライン", "指針",
    "規制", "省令", "告示", "通達", "パブリックコメント", "意見募集",
    "個人情報保護法", "漏えい", "漏洩", "マイナンバー", "特定個人情報",
    "国際移転", "越境移転", "データ利活用", "独占禁止法", "下請法", "取適法",
    "フリーランス法", "スマホソフトウェア競争促進法", "優越的地位",
    "カルテル", "入札談合", "企業結合", "確約手続", "排除措置命令",
    "課徴金", "報告書", "実態調査", "回収", "安全性速報", "添付文書改訂",
    "使用上の注意", "副作用", "不具合",
)
MORE_TOPICAL = (
    "経済安全保障", "安全保障貿易", "外為", "輸出管理", "重要物資",
    "エネルギー", "電力", "ガス", "再エネ", "GX", "脱炭素", "カーボン",
    "サイバー", "セキュリティ", "AI", "デジタル", "データ",
    "中小企業", "下請", "取引適正化",
    "景品表示法", "表示", "広告", "ステルスマーケティング",
    "消費者契約法", "消費者", "取引", "勧誘", "公益通報", "食品表示",
    "個人情報", "個人データ", "保有個人データ", "仮名加工情報", "匿名加工情報",
    "Q&A", "Ｑ＆Ａ", "Q＆A", "フリーランス", "公正取引委員会",
)
LOWERED = {
    "議事録": -6, "会議資料": -6, "検討会": -3, "審議会": -3,
    "統計": -5, "概数": -5, "月報": -4, "年報": -4,
    "更新されました": -4, "更新しました": -4, "ページを更新": -4,
    "委員会開催情報": -8, "議事概要": -6, "懇話会": -5, "委員会を開催": -6,
    "主な意見": -3, "ポスターコンクール": -7, "シンボルマーク": -7,
    "採用": -8, "調達": -8, "キッズ": -8,
    "国債金利情報": -8, "入札情報": -8, "スピーチ": -5, "講演": -4, "挨拶": -4,
    "メンテナンス": -6, "試験": -4, "出願状況": -5, "白書": -3, "見学": -7,
    "採択": -6, "公募": -4, "表彰式": -7, "コンクール": -7, "フォトコンテスト": -8,
}
NOISE = (
    "採用", "求人", "入札", "落札", "調達", "競争入札", "人事異動", "幹部名簿",
    "表彰", "セミナー", "シンポジウム", "イベント", "記者会見", "メールマガジン",
    "広報誌", "ＷＥＢマガジン", "WEBマガジン", "Webマガジン", "ウェブマガジン",
)
MORE_NOISE = (
    "採用", "調達", "入札", "公募", "イベント", "セミナー", "フォーラム", "表彰", "受賞",
    "大臣出張", "大臣会談", "会議開催", "懇談会開催", "研究会開催", "統計調査",
    "統計のみ", "白書", "月例報告", "ウェブマガジン", "広報誌", "キッズ", "見学案内",
    "価格見通し", "需給見通し", "参加者募集",
    "会談", "表敬", "出張", "意見交換を行いました", "開催します", "開催しました",
    "採用", "調達", "キッズ", "ポスターコンクール", "シンボルマーク",
)
SOURCE_BONUS = {"public_comment_rss": 4, "public_comment_html": 4, "public_comment_results_html": 4, "pmda_safety_html": 1, "court_html": 1, "enforcement_html": 1}
COMMENT_SOURCES = ("public_comment_rss", "public_comment_html", "public_comment_results_html")
COMMENT_WORDS = ("意見募集", "パブリックコメント", "パブリック・コメント", "パブコメ", "意見の募集", "御意見の募集", "ご意見の募集")
RESULT_WORDS = ("意見募集結果", "意見募集の結果", "意見の募集の結果", "パブリックコメントの結果", "結果の公示")
RESULT_WORDS_IN_COMMENT = ("結果について", "募集の結果", "結果")
CLOSED_WORDS = ("受付終了", "終了しました", "意見募集を終了", "募集を終了")
#: After the words of results: signs of a stage in the title or its lower case, in order.
STAGES = (
    Rule("Public Comment Closed", (*CLOSED_WORDS, "closed")),
    Rule("Public Comment Open", ("",), gates=("comment",)),
    Rule("In Force", ("施行されました", "施行しました")),
    Rule("Scheduled to Take Effect", ("施行期日", "施行日", "施行予定")),
    Rule("Promulgated", ("公布",)),
    Rule("Enacted", ("成立", "法"), every=True),
    Rule("Bill Submitted", ("法案", "法律案")),
    Rule("Bill Submitted", ("提出",), also=("法律", "法案", "国会")),
    Rule("Draft Guideline", ("案",), also=("指針", "ガイドライン", "Q&A", "Ｑ＆Ａ", "Q＆A", "FAQ", "考え方")),
)
DRAFT_NAMED_RESULT = "結果[^（(。、「」]{0,30}?[（(]案[）)]"
HINT_SOURCES = ("legislature_html", "law_api", "pmda_safety_html", "public_comment_results_html", "court_html", "enforcement_html")
HINTS = (
    "Bill Submitted", "Enacted", "Promulgated", "Scheduled to Take Effect", "In Force",
    "Government Announcement", "Public Comment Results Published", "Court Decision", "Enforcement Action",
)
IMPORTANT_WHEN_CLOSED = ("法律", "改正", "施行", "政令", "省令", "告示", "個人情報", "AI", "金融", "労働", "経済安全保障", "エネルギー")
STAGE_ORDER = {"Public Comment Open": 4.0, "Draft Guideline": 2.0, "Public Comment Results Published": 1.0, "Public Comment Closed": -14.0}
MEDIUM_WORDS = (
    "施行", "改正", "義務", "ガイドライン", "指針", "個人情報", "個人データ", "金融",
    "労働", "フリーランス", "下請", "AI", "ＡＩ", "人工知能", "規制", "プライバシー",
    "マネー", "資金洗浄", "経済安全保障", "外為", "外国為替", "公布", "告示", "通達",
    "回収", "安全性速報", "添付文書", "使用上の注意", "副作用", "不具合",
)
NARROW_WORDS = (
    "動物用", "獣医", "薬局製剤", "飼料", "農薬", "漁業", "養殖", "鳥獣", "船舶",
    "港湾", "航空機", "鉄道事業", "食品添加物", "水道", "と畜", "家畜", "植物防疫",
)
BROAD_WORDS = ("個人情報", "金融", "労働", "AI", "ＡＩ", "消費者", "環境", "税", "サイバー", "会社法", "下請", "フリーランス", "景品表示", "広告", "経済安全保障")
# ---- End of the fixed values.

FLOOR = 1.0
WEIGHTS = [
    *((w, 5) for w in STRONG), *((w, 5) for w in MORE_STRONG), *((w, 3) for w in MODERATE), *((w, 2) for w in TOPICAL),
    *((w, 2) for w in MORE_TOPICAL), *((w, 1) for w in WEAK), *LOWERED.items(),
]
IMPACT_ORDER = {"High": 3, "Medium": 2, "Low": 1}


def is_comment(source_type: Column) -> Column:
    return source_type.isin(*COMMENT_SOURCES)


def relevance(title: Column, source_type: Column) -> Column:
    bonus = F.lit(0.0)
    for kind, value in SOURCE_BONUS.items():
        bonus = F.when(source_type == kind, F.lit(float(value))).otherwise(bonus)
    return keyword_score(title, WEIGHTS) + bonus


def stage(title: Column, source_type: Column) -> Column:
    """Stage by the first sign that holds; general words of outcome count in consultations alone, and not where they name a draft."""
    both = F.concat_ws("\n", title, F.lower(title))
    comment = is_comment(source_type) | contains_any(both, (*COMMENT_WORDS, "public comment"))
    unnamed = F.regexp_replace(title, DRAFT_NAMED_RESULT, "")
    result = contains_any(both, (*RESULT_WORDS, "results published")) | (comment & contains_any(unnamed, RESULT_WORDS_IN_COMMENT))
    other = first_match(both, STAGES, "Government Announcement", F.when(comment, "comment").otherwise(""))
    return F.when(result, "Public Comment Results Published").otherwise(other)


def impact(title: Column, source_type: Column) -> Column:
    narrow = contains_any(title, NARROW_WORDS) & ~contains_any(title, BROAD_WORDS)
    other = F.when((source_type == "enforcement_html") | contains_any(title, MEDIUM_WORDS), "Medium").otherwise("Low")
    return F.when(is_comment(source_type), F.when(narrow, "Low").otherwise("Medium")).otherwise(other)


def stage_bonus(stage_: Column, title: Column) -> Column:
    out = F.lit(0.0)
    for name, value in STAGE_ORDER.items():
        out = F.when(stage_ == name, F.lit(value)).otherwise(out)
    return out + F.when((stage_ == "Public Comment Closed") & contains_any(title, IMPORTANT_WHEN_CLOSED), 2.0).otherwise(0.0)


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Ordered rules from JSON lines of label, words, every, gates; bounded by what a person can write."""
    rows = spark.read.schema("ord int, label string, words array<string>, every boolean, gates array<string>, also array<string>").json(path).orderBy("ord").collect()
    return [Rule(r["label"], tuple(r["words"] or ()), bool(r["every"]), tuple(r["gates"] or ()), tuple(r["also"] or ())) for r in rows]


def load_safe(spark: SparkSession, path: str) -> list[tuple]:
    """Ordered rules of safe English titles from JSON lines of marks, stage, words, title; for :func:`tidemill.functions.titles.english_title`."""
    rows = spark.read.schema("ord int, marks array<string>, stage string, words array<string>, title string").json(path).orderBy("ord").collect()
    return [(tuple(r["marks"] or ()), r["stage"] or "", tuple(r["words"] or ()), r["title"]) for r in rows]


def publish(raw: DataFrame, now: Column, areas: Sequence[Rule] = ()) -> DataFrame:
    """Raw notices (id, title_ja, source_name, source_type, published_at, ...) as the ranked published table.

    Excluded and low-scoring rows go, consultations always stay; a trusted hint replaces the stage that the title
    shows. Order: score with stage and age, impact, time, then ``ord`` (the input's place).
    """
    title, kind = F.coalesce("title_ja", F.lit("")), F.col("source_type")
    comment = is_comment(kind)
    rows = raw.where(comment | ~excluded_unless_rescued(title, NOISE + MORE_NOISE, STRONG + MORE_STRONG))
    rows = rows.withColumn("relevance_score", relevance(title, kind)).where(above_floor(F.col("relevance_score"), FLOOR, comment))
    rows = rows.withColumn("area", first_match(title, list(areas), "Other", F.col("source_name")))
    rows = rows.withColumn("stage", F.coalesce(trusted_hint(F.col("stage_hint"), kind, HINT_SOURCES, HINTS), stage(title, kind))).withColumn("impact_level", impact(title, kind))
    at = F.try_to_timestamp("published_at")
    order = F.round(F.col("relevance_score") + stage_bonus(F.col("stage"), title) - recency_penalty(at, now), 6)
    weight = F.element_at(F.create_map(*[F.lit(x) for p in IMPACT_ORDER.items() for x in p]), F.col("impact_level"))
    return ranked(rows.withColumn("order_score", order), F.col("order_score"), weight.desc(), F.desc_nulls_last(at), F.col("ord"))
