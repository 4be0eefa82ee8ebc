"""Queries of the legal notices' policy: titles made from orders, so that every sign of stage, impact and noise occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.rules import Rule
from ..sources.tables import table
from . import legal_notices as N
from .catalog import query

FRONTS = (
    "個人情報保護法施行令", "労働安全衛生規則", "動物用医薬品の基準", "食品表示基準", "採用情報", "入札に関する法律", "「建築基準法」", "漁業の許可", "AI事業者ガイドライン（案）",
    "経済安全保障推進法", "審議結果（案）", "統計月報", "FAQ", "外国為替令の一部改正", "環境影響評価の改訂案", "Draft Rule", "最高裁判決", "（受付終了）下請法", "キッズ見学", "報告書",
)
BACKS = (
    "に関する意見募集について", "の意見募集の結果", "の施行期日を定める政令", "を公布しました", "が成立", "を国会に提出", "が施行されました", "の考え方（案）", "結果について", "を掲載しました。",
    " results published", " (closed)", "の公表について", "", "のページを更新しました", "の漏えい", "の閣議決定", "に対する意見募集", " Public Comment",
)
SOURCES = ("National Tax Agency", "SESC", "JSDA", "Courts in Japan", "JPX Tokyo Stock Exchange", "PMDA", "衆議院", "e-Gov Law Search", "公正取引委員会 JFTC", "METI", "MLIT", "MAFF", "金融庁", "MHLW", "デジタル庁", "MOE", "e-Gov", "Ministry X")
TYPES = ("rss", "public_comment_rss", "enforcement_html", "court_html", "law_api", "html")
HINTS = (None, "In Force", "Court Decision", "Enforcement Action", "Rumour")
AREAS = (
    Rule("Privacy", ("個人情報",)), Rule("Labour", ("労働", "フリーランス")), Rule("Food", ("食品",), also=("表示", "安全")), Rule("Courts", ("判決",), gates=("Courts in Japan",)),
    Rule("Trade", ("外国為替", "輸出"), gates=("METI", "e-Gov")), Rule("Bills", ("法", "国会"), every=True),
)
TOPICS = (
    Rule("Environmental Impact Assessment Rules", ("環境影響評価",)), Rule("Response to Leaks", ("個人情報", "漏えい"), every=True), Rule("Personal Information Protection Rules", ("個人情報",)),
    Rule("Working Group Pages Updated", ("FAQ", "更新"), every=True), Rule("Subcontract Act Rules", ("下請法",)), Rule("Guidelines on AI", ("AI",)),
)
SAFE = (
    (("SESC",), "", ("法",), "SESC Enforcement Action: Act named"), (("JFTC",), "Public Comment", (), "JFTC Public Comment: Proposal"), (("METI", "MLIT"), "", ("基準", "許可"), "Standards or permits changed"),
    (("衆議院",), "Enacted", (), "Diet Bill Update: Bill enacted"),
)
NOW = "1999-01-01 00:00:00"


def _pick(values, place: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(place) % len(values) + 1).cast("int"))


def raw_notices(spark: SparkSession, d: str) -> DataFrame:
    """A notice for each order."""
    k = "o_orderkey"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        F.col(k).cast("long").alias("ord"),
        F.concat(_pick(FRONTS, k), _pick(BACKS, f"{k} div {len(FRONTS)}")).alias("title_ja"),
        _pick(SOURCES, f"{k} div 7").alias("source_name"), _pick(TYPES, f"{k} div 3").alias("source_type"), _pick(HINTS, f"{k} div 11").alias("stage_hint"),
        F.when(F.col(k) % 13 == 0, "").otherwise(F.concat(day, F.lit("T00:00:00Z"))).alias("published_at"),
    )


# ------------------------------------------------------------------- SQL


def _s(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _at(values, place: str) -> str:
    return f"[{', '.join(_s(v) for v in values)}][({place}) % {len(values)} + 1]"


def _has(column: str, words, join: str = " OR ") -> str:
    return "(" + (join.join(f"contains({column}, {_s(w)})" for w in words) or "false") + ")"


def _rules(column: str, rules, default: str, gate: str = "''") -> str:
    out = "CASE"
    for r in rules:
        test = _has(column, r.words, " AND " if r.every else " OR ")
        test += f" AND {_has(column, r.also)}" if r.also else ""
        test += f" AND {gate} IN ({', '.join(map(_s, r.gates))})" if r.gates else ""
        out += f" WHEN {test} THEN {_s(r.label)}"
    return f"{out} ELSE {_s(default)} END"


def _marked(rules, default: str | None) -> str:
    if not rules:
        return _s(default)
    tests = [" AND ".join([_has("source_name", m)] * bool(m) + [f"starts_with(stage, {_s(b)})"] * bool(b) + [_has("t", w)] * bool(w)) or "true" for m, b, w, _ in rules]
    return "CASE " + " ".join(f"WHEN {t} THEN {_s(r[3])}" for t, r in zip(tests, rules)) + f" ELSE {_s(default)} END"


def _in(values) -> str:
    return "(" + ", ".join(map(_s, values)) + ")"


_BOTH = "(t || chr(10) || lower(t))"
_COMMENT = f"(source_type IN {_in(N.COMMENT_SOURCES)} OR {_has(_BOTH, (*N.COMMENT_WORDS, 'public comment'))})"
_STAGE = f"""CASE WHEN {_has(_BOTH, (*N.RESULT_WORDS, 'results published'))} OR ({_COMMENT} AND {_has(f"regexp_replace(t, {_s(N.DRAFT_NAMED_RESULT)}, '', 'g')", N.RESULT_WORDS_IN_COMMENT)}) THEN 'Public Comment Results Published'
 ELSE {_rules(_BOTH, N.STAGES, 'Government Announcement', f"CASE WHEN {_COMMENT} THEN 'comment' ELSE '' END")} END"""
_IMPACT = f"""CASE WHEN source_type IN {_in(N.COMMENT_SOURCES)} THEN CASE WHEN {_has("t", N.NARROW_WORDS)} AND NOT {_has("t", N.BROAD_WORDS)} THEN 'Low' ELSE 'Medium' END
 WHEN source_type = 'enforcement_html' OR {_has("t", N.MEDIUM_WORDS)} THEN 'Medium' ELSE 'Low' END"""
_SCORE = " + ".join(f"CASE WHEN contains(t, {_s(w)}) THEN {float(x)}::DOUBLE ELSE 0 END" for w, x in N.WEIGHTS) + " + CASE source_type " + " ".join(f"WHEN {_s(k)} THEN {float(v)}::DOUBLE" for k, v in N.SOURCE_BONUS.items()) + " ELSE 0 END"
_RAW = f"""SELECT o_orderkey::BIGINT AS ord, {_at(FRONTS, "o_orderkey")} || {_at(BACKS, f"o_orderkey // {len(FRONTS)}")} AS t, {_at(SOURCES, "o_orderkey // 7")} AS source_name,
 {_at(TYPES, "o_orderkey // 3")} AS source_type, {_at(HINTS, "o_orderkey // 11")} AS stage_hint, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate::DATE END AS posted FROM orders"""
_NOTICES = f"""WITH raw AS ({_RAW}),
judged AS (SELECT *, coalesce(CASE WHEN source_type IN {_in(N.HINT_SOURCES)} AND stage_hint IN {_in(N.HINTS)} THEN stage_hint END, {_STAGE}) AS stage, {_IMPACT} AS impact_level, {_SCORE} AS relevance_score,
 {_has("t", N.NOISE + N.MORE_NOISE)} AND NOT {_has("t", N.STRONG + N.MORE_STRONG)} AS noise, source_type IN {_in(N.COMMENT_SOURCES)} AS comment, {_rules("t", AREAS, "Other", "source_name")} AS area FROM raw)"""


@query("notice_stage_impact", _NOTICES + " SELECT ord, stage, impact_level, relevance_score, noise AND NOT comment AS excluded FROM judged")
def notice_stage_impact(spark: SparkSession, d: str) -> DataFrame:
    raw, title, kind = raw_notices(spark, d), F.col("title_ja"), F.col("source_type")
    stage = F.coalesce(N.trusted_hint(F.col("stage_hint"), kind, N.HINT_SOURCES, N.HINTS), N.stage(title, kind))
    noise = N.excluded_unless_rescued(title, N.NOISE + N.MORE_NOISE, N.STRONG + N.MORE_STRONG)
    return raw.select("ord", stage.alias("stage"), N.impact(title, kind).alias("impact_level"), N.relevance(title, kind).alias("relevance_score"), (noise & ~N.is_comment(kind)).alias("excluded"))


_BONUS = "CASE stage " + " ".join(f"WHEN {_s(k)} THEN {float(v)}::DOUBLE" for k, v in N.STAGE_ORDER.items()) + f" ELSE 0 END + CASE WHEN stage = 'Public Comment Closed' AND {_has('t', N.IMPORTANT_WHEN_CLOSED)} THEN 2.0::DOUBLE ELSE 0 END"


@query("notices_published", _NOTICES + f""",
kept AS (SELECT *, round(relevance_score + ({_BONUS}) - CASE WHEN posted IS NULL THEN 8.0::DOUBLE ELSE least(greatest(date_diff('day', posted, DATE '{NOW[:10]}'), 0) * 0.15::DOUBLE, 6.0) END, 6) AS order_score
 FROM judged WHERE comment OR (NOT noise AND relevance_score >= {N.FLOOR}))
SELECT ord, area, stage, impact_level, order_score, row_number() OVER (ORDER BY order_score DESC, CASE impact_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, posted DESC NULLS LAST, ord) AS rank FROM kept""")
def notices_published(spark: SparkSession, d: str) -> DataFrame:
    found = N.publish(raw_notices(spark, d), F.lit(NOW).cast("timestamp"), AREAS)
    return found.select("ord", "area", "stage", "impact_level", "order_score", "rank")


def _first(cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + f" ELSE {default} END"


_PAIRS = "|".join(f"^{a}(.*){b}$" for a, b in titles.QUOTES).replace("'", "''")


def _unquoted(x: str) -> str:
    for _ in range(4):
        x = f"trim(regexp_replace({x}, '(?s){_PAIRS}', '{''.join(chr(92) + str(i + 1) for i in range(len(titles.QUOTES)))}'))"
    return x


def _subject(t: str) -> list[str]:
    """Steps of the subject, each a column over the one before."""
    steps = [f"trim(regexp_replace(trim({t}), '^[（(]\\s*受付終了\\s*[）)]', ''))"]
    quoted = "regexp_extract(x, '^「([^」]+)」', 1)"
    steps.append(_first([(f"{quoted} <> '' AND {_has('x', ('掲載', 'ページ'))}", quoted), *[(f"contains(x, {_s(m)})", f"split_part(x, {_s(m)}, 1)") for m in titles.SUBJECT_ENDS]], "x"))
    steps.append(_unquoted("trim(x)"))
    steps += [f"CASE WHEN ends_with(x, {_s(p)}) THEN trim(left(x, length(x) - {len(p)})) ELSE x END" for p in titles.TRAILING]
    steps.append(_unquoted("trim(x)"))
    return [*steps, "regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ 。]+|[ 。]+$', '', 'g')"]


_SUBJECT = "SELECT *, t AS x FROM judged"
for _step in _subject("x"):
    _SUBJECT = f"SELECT * REPLACE ({_step} AS x) FROM ({_SUBJECT})"
_KNOWN = _first([
    ("ends_with(topic, 'Updated') OR " + " OR ".join(f"starts_with(topic, {_s(w)})" for w in titles.WHOLE_TOPICS), "topic"), ("contains(t, '閣議決定')", "'Cabinet Decision on ' || topic"), (_has("t", titles.LEAKS), "topic"),
    ("contains(t, '更新')", "topic || ' Updated'"), (_has("x", titles.REVISED), "'Draft Revision to ' || topic"), (_has("x", titles.AMENDED), "'Draft Amendment to ' || topic"), (_has("x", titles.DRAFT), "'Draft ' || topic"),
], "topic")
_NAMED = _first([
    ("topic <> ''", _KNOWN), (_has("x", titles.AMENDED), "'Draft Amendment to ' || x"), (_has("x", titles.REVISED), "'Draft Revision to ' || x"), (f"{_has('x', titles.DRAFT)} AND {_has('x', titles.RULES)}", "'Draft Guidelines or Rules: ' || x"),
], "x")


@query("notice_titles_en", _NOTICES + f""",
about AS ({_SUBJECT}), topical AS (SELECT *, {_rules("(x || ' ' || t)", TOPICS, "")} AS topic, {_marked(titles.PREFIXES, titles.PREFIX)} AS prefix FROM about),
made AS (SELECT *, prefix || ': ' || CASE WHEN NOT contains(prefix, 'Public Comment') AND stage = 'Public Comment Closed' THEN 'Closed public comment on ' WHEN NOT contains(prefix, 'Public Comment') AND stage = 'Public Comment Results Published' THEN 'Public comment results on ' ELSE '' END || {_NAMED} AS m FROM topical),
safe AS (SELECT *, CASE WHEN regexp_matches(m, '{titles.JAPANESE}') THEN coalesce({_marked(SAFE, None)}, CASE stage {" ".join(f"WHEN {_s(a)} THEN {_s('Public Comment' + b)}" for a, b in titles.CONSULTATIONS)} END,
 {_marked([(m, "", (), n) for m, n in titles.LABELS], titles.LABEL)} || ' Update: Regulatory announcement related to ' || CASE WHEN area = 'Other' THEN {_s(titles.NO_AREA)} ELSE area END) ELSE m END AS m2 FROM made),
cut AS (SELECT *, rtrim(left(m2, 117)) AS head FROM safe)
SELECT ord, CASE WHEN length(m2) <= 120 THEN m2 WHEN length(regexp_extract(head, '(?s)^(.*) [^ ]*$', 1)) >= 72 THEN rtrim(regexp_extract(head, '(?s)^(.*) [^ ]*$', 1)) || '...' ELSE head || '...' END AS title_en FROM cut""")
def notice_titles_en(spark: SparkSession, d: str) -> DataFrame:
    raw, title, kind, source = raw_notices(spark, d), F.col("title_ja"), F.col("source_type"), F.col("source_name")
    raw = raw.withColumn("stage", F.coalesce(N.trusted_hint(F.col("stage_hint"), kind, N.HINT_SOURCES, N.HINTS), N.stage(title, kind)))
    raw = raw.withColumn("area", N.first_match(title, list(AREAS), "Other", source))
    return raw.select("ord", titles.english_title(title, source, F.col("stage"), F.col("area"), TOPICS, SAFE).alias("title_en"))
