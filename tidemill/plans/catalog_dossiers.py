"""Queries of dossiers and of parts of titles: customers stand for dossiers, the parts that they ordered for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cases
from ..operators import dossiers as D
from ..sources.tables import table
from .catalog import query
from .catalog_notices import _NOTICES, raw_notices

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_CLOSURE = "closure AS (SELECT DISTINCT o_custkey AS dossier, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _closure(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("dossier")).join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("dossier", "item").distinct()


def _list(column: str, distinct: bool = False) -> str:
    """A sorted list as text."""
    return f"array_to_string(list_sort(list({'DISTINCT ' * distinct}{column})), ',')"


@query("claim_map", f"WITH {_CLOSURE} SELECT item, min(dossier) AS dossier, count(*) AS claimants FROM closure GROUP BY 1")
def claim_map(spark, d):
    return D.claims(_closure(spark, d), "dossier", "item")


@query("shown_items", f"WITH {_CLOSURE} SELECT item, max(dossier) AS dossier FROM closure WHERE dossier IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def shown_items(spark, d):
    publishable = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("dossier"))
    return D.shown_on(_closure(spark, d), publishable, "dossier", "item")


@query("closure_values", f"WITH {_CLOSURE} SELECT dossier, {_list('p_type', True)} AS \"values\" FROM closure JOIN part ON p_partkey = item GROUP BY 1")
def closure_values(spark, d):
    types = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_type")
    return D.values_in(_closure(spark, d), types, "dossier", "item", "p_type").select("dossier", F.array_join("values", ",").alias("values"))


_RECORDS = "records AS (SELECT p_partkey AS item, CASE WHEN p_size % 11 > 0 THEN p_brand END AS number, CASE WHEN p_size % 7 > 0 THEN p_type END AS target, CASE WHEN p_size % 5 > 0 THEN p_size END AS effective FROM part)"


@query("page_legal_status", f"""WITH {_CLOSURE}, {_RECORDS}, own AS (SELECT dossier, r.* FROM closure JOIN records r USING (item) WHERE number IS NOT NULL),
s AS (SELECT dossier, number, target, coalesce(array_to_string(list_sort(list(DISTINCT effective) FILTER (effective IS NOT NULL)), ','), '') AS effective_dates, bool_or(effective IS NULL) AS pending FROM own GROUP BY 1, 2, 3)
SELECT item, o.dossier, effective_dates, pending FROM own o JOIN s ON s.dossier = o.dossier AND s.number = o.number AND s.target IS NOT DISTINCT FROM o.target""")
def page_legal_status(spark, d):
    size = F.col("p_size")
    records = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(size % 11 > 0, F.col("p_brand")).alias("number"), F.when(size % 7 > 0, F.col("p_type")).alias("target"), F.when(size % 5 > 0, size).alias("effective"))
    found = D.page_status(_closure(spark, d), records, "item", "dossier", "number", "target", "effective")
    return found.withColumn("effective_dates", F.array_join(F.transform("effective_dates", lambda x: x.cast("string")), ","))


_FACTS = "facts AS (SELECT o_custkey AS dossier, o_orderkey AS fact, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'not_applicable' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unconfirmed' ELSE 'confirmed' END END AS status FROM orders)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    open_ = F.when(key % 3 == 0, "unconfirmed").otherwise("confirmed")
    status = F.when(status == "F", "confirmed").when(status == "P", "not_applicable").when(status == "O", open_)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("dossier"), key.alias("fact"), F.col("o_orderpriority").alias("category"), status.alias("status"))


_GAPS = f"""gaps AS (SELECT dossier, list_filter([{', '.join(f"CASE WHEN coalesce(bool_or(category = '{c}' AND status IN ('confirmed', 'not_applicable')), false) AND NOT coalesce(bool_or(category = '{c}' AND NOT coalesce(status IN ('confirmed', 'not_applicable'), false)), false) THEN NULL ELSE '{c}' END" for c in CATEGORIES)}], lambda x: x IS NOT NULL) AS gaps FROM facts GROUP BY 1)"""


@query("critical_gaps", f"WITH {_FACTS}, {_GAPS} SELECT dossier, array_to_string(gaps, ',') AS gaps FROM gaps")
def critical_gaps(spark, d):
    return D.open_categories(_facts(spark, d), "dossier", "category", "status", CATEGORIES).select("dossier", F.array_join("gaps", ",").alias("gaps"))


_STAGES = {"bill": ("FURNITURE", "MACHINERY"), "act": ("BUILDING",)}


@query("publication_gate", f"""WITH {_FACTS}, {_GAPS}, {_CLOSURE}, own AS (SELECT dossier, list(item) AS items FROM closure GROUP BY 1)
SELECT c_custkey AS dossier, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN gaps IS NOT NULL THEN array_to_string(list_filter([CASE WHEN len(gaps) > 0 THEN 'facts' END, CASE WHEN c_custkey % 5 = 0 THEN 'hold' END,
 CASE WHEN CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment NOT IN ('FURNITURE', 'MACHINERY') WHEN c_custkey % 3 = 2 THEN c_mktsegment <> 'BUILDING' END THEN 'form' END, CASE WHEN len(coalesce(items, [])) > 0 AND NOT list_contains(items, c_custkey) THEN 'seed' END], lambda x: x IS NOT NULL), ',')
 WHEN c_custkey % 2 = 0 THEN 'case file' ELSE '' END AS reasons FROM customer LEFT JOIN gaps g ON g.dossier = c_custkey LEFT JOIN own ON own.dossier = c_custkey""")
def publication_gate(spark, d):
    gaps = D.open_categories(_facts(spark, d), "dossier", "category", "status", CATEGORIES).withColumnRenamed("dossier", "g")
    own = _closure(spark, d).groupBy(F.col("dossier").alias("o")).agg(F.collect_set("item").alias("items"))
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").join(gaps, key == F.col("g"), "left").join(own, key == F.col("o"), "left")
    reasons = D.gate(
        F.when(key % 4 == 0, "draft").otherwise("published"), F.col("gaps").isNotNull(), key % 2 == 0, F.col("gaps"), F.when(key % 5 == 0, "BLOCKED").otherwise("READY"),
        F.when(key % 3 == 1, "bill").when(key % 3 == 2, "act"), F.col("c_mktsegment"), _STAGES, key, F.coalesce("items", F.array().cast("array<bigint>")),
    )
    return rows.select(key.alias("dossier"), F.array_join(reasons, ",").alias("reasons"))


_POLICY = {"facts": "ai_checked", "procedure": "human_reviewed", "outlook": "unreviewed"}
_REVIEW = "CASE WHEN coalesce(nullif(r, 'none'), 'unreviewed') = 'human_reviewed' AND NOT coalesce(reviewed >= verified, false) THEN 'ai_checked' ELSE coalesce(nullif(r, 'none'), 'unreviewed') END"


@query("visible_categories", f"""WITH d AS (SELECT o_orderkey, ['none', 'ai_checked', 'human_reviewed'][o_orderkey % 3 + 1] AS base, CASE WHEN o_orderkey % 4 = 0 THEN ['ai_checked', 'human_reviewed', 'none'][o_orderkey % 7 % 3 + 1] END AS section,
 CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS reviewed, o_orderdate + to_days((o_orderkey % 3 - 1)::INT) AS verified FROM orders),
p AS (SELECT o_orderkey, {_REVIEW.replace("r,", "coalesce(section, base),")} AS facts, {_REVIEW.replace("r,", "base,")} AS whole FROM d)
SELECT o_orderkey, facts, whole, array_to_string(list_filter([CASE WHEN facts IN ('ai_checked', 'human_reviewed') THEN 'facts' END, CASE WHEN whole = 'human_reviewed' THEN 'procedure' END, 'outlook'], lambda x: x IS NOT NULL), ',') AS visible FROM p""")
def visible_categories(spark, d):
    key = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    base, section = pick(("none", "ai_checked", "human_reviewed"), key % 3), F.when(key % 4 == 0, pick(("ai_checked", "human_reviewed", "none"), key % 7 % 3))
    reviewed = F.when(key % 5 > 0, F.col("o_orderdate"))
    verified = F.col("o_orderdate") + F.make_dt_interval((key % 3 - 1).cast("int"))
    rows = table(spark, d, "orders").select(key, D.review_of(section, base, reviewed, verified).alias("facts"), D.review_of(F.lit(None).cast("string"), base, reviewed, verified).alias("whole"))
    shown = D.visible({"facts": F.col("facts"), "procedure": F.col("whole"), "outlook": F.col("whole")}, _POLICY)
    return rows.select(key, "facts", "whole", F.array_join(shown, ",").alias("visible"))


@query("uncited_facts", """WITH f AS (SELECT l_orderkey AS dossier, l_linenumber AS fact, CASE WHEN l_quantity >= 10 THEN l_suppkey END AS source FROM lineitem), s AS (SELECT s_suppkey, 'u' || s_nationkey AS url FROM supplier),
c AS (SELECT DISTINCT o_orderkey AS dossier, 'u' || o_orderkey % 25 AS url FROM orders UNION SELECT o_orderkey, 'u' || o_custkey % 25 FROM orders)
SELECT f.dossier, fact FROM f LEFT JOIN s ON s_suppkey = source LEFT JOIN c ON c.dossier = f.dossier AND c.url = s.url GROUP BY 1, 2 HAVING count(c.url) = 0""")
def uncited_facts(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dossier"), F.col("l_linenumber").alias("fact"), F.when(F.col("l_quantity") >= 10, F.col("l_suppkey")).alias("source"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.concat(F.lit("u"), "s_nationkey").alias("url"))
    orders = table(spark, d, "orders")
    cited = orders.select(F.col("o_orderkey").alias("dossier"), F.explode(F.array(F.concat(F.lit("u"), F.col("o_orderkey") % 25), F.concat(F.lit("u"), F.col("o_custkey") % 25))).alias("url"))
    return D.uncited(facts, sources, cited, "fact", "dossier", "source", "url")


@query("research_packets", """WITH closure AS (SELECT s_nationkey AS dossier, s_suppkey AS item FROM supplier), q AS (SELECT c_custkey % 140 AS seed, CASE WHEN c_custkey % 3 = 0 THEN 0 END AS wrong FROM customer WHERE c_acctbal > 0),
asked AS (SELECT seed, count(*) AS times, max(wrong) AS wrong FROM q GROUP BY 1), sizes AS (SELECT dossier, count(*) AS n FROM closure GROUP BY 1),
k AS (SELECT seed, c.dossier, CASE WHEN times > 1 THEN 'duplicate' WHEN c.dossier IS NULL THEN 'unknown' WHEN n <> wrong THEN 'count' END AS problem FROM asked LEFT JOIN closure c ON item = seed LEFT JOIN sizes s ON s.dossier = c.dossier)
SELECT seed, c.item, left(s_name, 14) AS text, length(s_name) > 14 AS truncated, NULL::VARCHAR AS problem FROM k JOIN closure c ON c.dossier = k.dossier JOIN supplier ON s_suppkey = c.item WHERE problem IS NULL
UNION ALL SELECT seed, NULL, NULL, false, problem FROM k WHERE problem IS NOT NULL""")
def research_packets(spark, d):
    supplier = table(spark, d, "supplier")
    closure = supplier.select(F.col("s_nationkey").alias("dossier"), F.col("s_suppkey").alias("item"))
    queue = table(spark, d, "customer").where("c_acctbal > 0").select((F.col("c_custkey") % 140).alias("seed"), F.when(F.col("c_custkey") % 3 == 0, 0).alias("n"))
    return D.packets(queue, closure, supplier.select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("text")), "seed", "n", "dossier", "item", "text", 14)


_MARKERS = {"en": ("/en/",), "fr": ("/fr/", "utm"), "mobile": ("m.", "mobile"), "feed": ("feed",)}
_HOSTS = (("com", ("/en/", "/de/"), ("example.com",)), ("org", ("/en/", "/es/"), ("example.org", "example.net")), ("any", ("feed",), ("example.com", "example.org")))
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1))"


@query("named_agencies", f"""SELECT page_id, CASE WHEN contains(url, '://') THEN array_to_string(list_sort(list_filter([{', '.join("CASE WHEN " + " OR ".join(f"contains(substr(url, strpos(url, '://') + 3), '{m}')" for m in marks) + f" THEN '{name}' END" for name, marks in _MARKERS.items())}], lambda x: x IS NOT NULL)), ',') ELSE '' END AS contacts,
 CASE WHEN len(hits) = 1 THEN hits[1] END AS target FROM (SELECT page_id, url, list_filter([{', '.join("CASE WHEN (" + " OR ".join(f"contains(url, '{m}')" for m in marks) + ") AND (" + " OR ".join(f"{_HOST} = '{x}' OR ends_with({_HOST}, '.{x}')" for x in domains) + f") THEN '{r}' END" for r, marks, domains in _HOSTS)}], lambda x: x IS NOT NULL) AS hits FROM pages)""")
def named_agencies(spark, d):
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]*)", 1))
    return table(spark, d, "pages").select("page_id", F.array_join(F.coalesce(D.named_in(url, "://", _MARKERS), F.array().cast("array<string>")), ",").alias("contacts"), D.only_one(url, host, _HOSTS).alias("target"))


_DETAIL = r"\d+(?:\.\d+)?\s*(?:％|%|円|日|月|年|条|号)|第[\d一二三四五六七八九十百千]+条"


@query("draft_names_cases", _NOTICES + f""", t2 AS (SELECT ord, replace(replace(replace(replace(replace(t || '規則（案）に対する意見', '（', '('), '）', ')'), '(案)', '（案）'), '「', ''), '」', '') AS n, '平成' || ord % 40 || '(' || ['行ツ', '受', 'あ', '甲', '許'][ord % 5 + 1] || ')' || ord || '、令和元(ラ)' || ord % 3 AS c FROM raw)
SELECT ord, regexp_extract(n, '{cases.DRAFT}', 1) AS draft, CASE WHEN ord % 5 = 3 THEN '' ELSE 1988 + ord % 40 || ' ' || ['Gyo-Tsu', 'Ju', 'A', '', 'Kyo'][ord % 5 + 1] || ' ' || ord || ',' END || '2019 Ra ' || ord % 3 AS cases,
 len(regexp_extract_all(c || ord || '％', '{_DETAIL}')) AS details FROM t2""")
def draft_names_cases(spark, d):
    raw, key = raw_notices(spark, d), F.col("ord")
    code = F.element_at(F.array(*[F.lit(c) for c in ("行ツ", "受", "あ", "甲", "許")]), (key % 5 + 1).cast("int"))
    text = F.concat(F.lit("平成"), key % 40, F.lit("("), code, F.lit(")"), key, F.lit("、令和元(ラ)"), key % 3)
    written = F.transform(cases.case_numbers(text), lambda c: F.concat_ws(" ", c["year"].cast("string"), c["code"], c["number"].cast("string")))
    details = F.size(F.regexp_extract_all(F.concat(text, key, F.lit("％")), F.lit(_DETAIL), F.lit(0))).cast("long")
    return raw.select("ord", cases.draft_name(F.concat("title_ja", F.lit("規則（案）に対する意見"))).alias("draft"), F.array_join(written, ",").alias("cases"), details.alias("details"))
