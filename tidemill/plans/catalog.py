"""Every query on the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, hashing, rules, text
from ..operators import compare, identity, linking, publish, ranking, state
from ..sources import feeds_out, markup
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _case(weights) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {x}::DOUBLE ELSE 0 END" for w, x in weights)


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


WEIGHTS = [("password", 5.0), ("token", 5.0), ("license", 3.0), ("worthless", 2.0), ("trash", 2.0), ("mail", 1.0), ("tion", 1.0), ("the", 1.0), ("der", 1.0), ("the", 1.0)]
NOISE, RESCUE = ["loser", "moron", "scum"], ["license", "token", "copyright"]
AREAS = [rules.Rule("Security", ("password", "token", "akia")), rules.Rule("Licensing", ("license", "copyright")), rules.Rule("Contact", ("@", "http")), rules.Rule("Long form", ("tion", "ment"), every=True)]
STAGES = [rules.Rule("Final", ("released",)), rules.Rule("Draft", ("que",)), rules.Rule("Open", ("the ",), gates=("src1", "src2", "src3"))]
BONUS = {"Final": 4.0, "Draft": 2.0, "Open": 1.0}
POLICY = publish.Policy(WEIGHTS, NOISE, RESCUE, AREAS, STAGES, 2.0, BONUS)
_SCORED = f"""SELECT *, CASE WHEN {_any(AREAS[0].words)} THEN 'Security' WHEN {_any(AREAS[1].words)} THEN 'Licensing' WHEN {_any(AREAS[2].words)} THEN 'Contact'
 WHEN contains(t, 'tion') AND contains(t, 'ment') THEN 'Long form' ELSE 'Other' END AS area,
 CASE WHEN contains(t, 'released') THEN 'Final' WHEN contains(t, 'que') THEN 'Draft' WHEN source IN ('src1', 'src2', 'src3') AND contains(t, 'the ') THEN 'Open' ELSE 'Update' END AS stage
 FROM (SELECT *, {_case(WEIGHTS)} AS score FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents) WHERE NOT ({_any(NOISE)} AND NOT {_any(RESCUE)})) WHERE source = 'src0' OR score >= 2.0"""
NOW, TODAY = "2024-02-01 00:00:00", "2024-01-31"


@query("kw_score_rank", f"""
SELECT doc_id, area, stage, score, order_score, row_number() OVER (ORDER BY order_score DESC, doc_id) AS rank FROM (
 SELECT *, round(score + CASE stage WHEN 'Final' THEN 4.0::DOUBLE WHEN 'Draft' THEN 2.0 WHEN 'Open' THEN 1.0 ELSE 0.0 END
  - least(greatest((doc_id % 90)::DOUBLE, 0) * 0.15::DOUBLE, 6.0), 6) AS order_score FROM ({_SCORED}))""")
def kw_score_rank(spark, d):
    at = F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - (F.col("doc_id") % 90) * 86_400_000_000)
    rows = publish.published(table(spark, d, "documents"), "text", "doc_id", POLICY, F.col("source") == "src0", at, F.lit(NOW).cast("timestamp"), F.col("source"))
    return rows.select("doc_id", "area", "stage", "score", "order_score", "rank")


@query("exclude_with_rescue", f"SELECT doc_id FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) WHERE {_any(NOISE)} AND NOT {_any(RESCUE)}")
def exclude_with_rescue(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").where(rules.excluded_unless_rescued(low, NOISE, RESCUE)).select("doc_id")


@query("first_match_class", "SELECT p_partkey, CASE WHEN contains(p_name, 'widget') OR contains(p_name, 'gizmo') THEN 'device' WHEN contains(p_name, 'bolt') OR contains(p_name, 'ring') THEN 'fitting' ELSE 'other' END AS class FROM part")
def first_match_class(spark, d):
    own = [rules.Rule("device", ("widget", "gizmo")), rules.Rule("fitting", ("bolt", "ring"))]
    return table(spark, d, "part").select("p_partkey", rules.first_match(F.col("p_name"), own, "other").alias("class"))


@query("topic_all_keywords", "SELECT doc_id, CASE WHEN contains(text, 'tion') AND contains(text, 'the') AND contains(text, 'wh') THEN 'english' WHEN contains(text, 'eau') AND contains(text, 'que') THEN 'french' WHEN contains(text, 'sch') AND contains(text, 'der') THEN 'german' END AS topic FROM documents")
def topic_all_keywords(spark, d):
    own = [rules.Rule("english", ("tion", "the", "wh"), True), rules.Rule("french", ("eau", "que"), True), rules.Rule("german", ("sch", "der"), True)]
    return table(spark, d, "documents").select("doc_id", rules.first_match(F.col("text"), own, None).alias("topic"))


@query("append_dedupe", """
WITH h AS (SELECT * FROM pages WHERE page_id % 3 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id // 2 ORDER BY page_id) AS n FROM pages WHERE page_id % 3 <> 0)
SELECT page_id, url FROM b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.page_id // 2 = b.page_id // 2)
 AND NOT (contains(b.url, 'utm') AND EXISTS (SELECT 1 FROM h WHERE h.url = b.url))""")
def append_dedupe(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url").withColumn("event", F.floor(F.col("page_id") / 2))
    out = identity.append_unseen(pages.where("page_id % 3 = 0"), pages.where("page_id % 3 <> 0"), "event", "url", F.col("url").contains("utm"), "page_id")
    return out.select("page_id", "url")


@query("stable_id_hash", "SELECT page_id, 'raw-' || substr(sha256(CASE WHEN page_id % 5 = 0 THEN 'event:' || page_id ELSE 'url:' || url END), 1, 16) AS id, substr(sha256(url || chr(10) || page_id), 1, 24) AS content FROM pages")
def stable_id_hash(spark, d):
    event = F.when(F.col("page_id") % 5 == 0, F.col("page_id").cast("string"))
    own = hashing.stable_id("raw-", event, F.col("url"), [F.col("html")])
    return table(spark, d, "pages").select("page_id", own.alias("id"), hashing.digest(F.col("url"), F.col("page_id"), length=24).alias("content"))


@query("blob_hash", "SELECT item_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob FROM benchmark WHERE NOT contains(text, chr(0))")
def blob_hash(spark, d):
    return table(spark, d, "benchmark").where(~F.col("text").contains("\0")).select("item_id", hashing.blob_hash(F.col("text")).alias("blob"))


@query("html_title_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS title FROM pages")
def html_title_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.tag_text(F.col("html"), "title").alias("title"))


@query("html_links", """SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.link_targets(F.col("html"))).alias("place", "link")).select("page_id", "link", F.col("place").cast("long").alias("place"))


@query("html_parsed_links")
def html_parsed_links(spark, d):
    return markup.entries(table(spark, d, "pages"), "html", "links", ["page_id"])


@query("url_host_domain", "SELECT page_id, h AS host, h = 'example.com' OR ends_with(h, '.example.com') AS under FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)")
def url_host_domain(spark, d):
    h = text.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", h.alias("host"), text.under_domain(h, F.lit("example.com")).alias("under"))


@query("safe_urls", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@\x00-\x20\x7F]+([/?#][^\x00-\x20\x7F]*)?$') THEN url END AS url, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def safe_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_url(F.col("url")).alias("url"), text.query_value(F.col("url"), "page").alias("page"))


@query("host_page_counts", "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def host_page_counts(spark, d):
    return ranking.top_counts(table(spark, d, "pages").select(text.host(F.col("url")).alias("host")), "host", 20)


@query("period_shards_manifest", "SELECT year(o_orderdate)::VARCHAR AS period, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def period_shards_manifest(spark, d):
    return state.shards(table(spark, d, "orders"), dates.period_of(F.col("o_orderdate").cast("date")))


@query("manifest_check", "SELECT count(*) = count(DISTINCT p) AS distinct_parts, sum(n) = (SELECT count(*) FROM orders) AS adds_up, min(n) >= 0 AS no_negative FROM (SELECT year(o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1)")
def manifest_check(spark, d):
    orders = table(spark, d, "orders")
    parts = orders.groupBy(F.year("o_orderdate").alias("p")).agg(F.count("*").alias("n"))
    return compare.partition_check(parts, "p", "n", orders.count())


@query("preview_whole_days", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, rank() OVER (ORDER BY o_orderdate DESC) AS r, count(*) OVER () AS n FROM orders) WHERE r <= 100 AND n > 100")
def preview_whole_days(spark, d):
    rows = ranking.whole_days(table(spark, d, "orders"), "o_orderdate", 100)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("top_sources_ties", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_sources_ties(spark, d):
    return ranking.top_counts(table(spark, d, "documents"), "source", 10)


@query("weekly_rollup", "SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(o_orderdate, '%G-w%V') AS slug, c_mktsegment AS area, count(*) AS n, sum((o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def weekly_rollup(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return rows.groupBy(F.date_format(dates.week_monday(day), "yyyy-MM-dd").alias("week"), dates.week_slug(day).alias("slug"), F.col("c_mktsegment").alias("area")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


@query("week_round_robin", """
WITH r AS (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, c_mktsegment AS area, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, count(*) OVER (PARTITION BY week, area) AS size, row_number() OVER (PARTITION BY week, area ORDER BY o_totalprice DESC, o_orderkey) AS k FROM r)
SELECT week, area, o_orderkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY k, size DESC, area) AS turn FROM k WHERE k <= 3) WHERE turn <= 10""")
def week_round_robin(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.date_format(dates.week_monday(F.col("o_orderdate")), "yyyy-MM-dd").alias("week"), F.col("c_mktsegment").alias("area"), "o_orderkey", "o_totalprice")
    out = ranking.round_robin(rows, ["week"], "area", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 10)
    return out.select("week", "area", "o_orderkey", F.col("turn").cast("long").alias("turn"))


@query("period_pair_change", "SELECT event_type, count(*) FILTER (ts >= DATE '2024-01-22') AS now, count(*) FILTER (ts < DATE '2024-01-22') AS before, CASE WHEN count(*) FILTER (ts < DATE '2024-01-22') > 0 THEN round((count(*) FILTER (ts >= DATE '2024-01-22') - count(*) FILTER (ts < DATE '2024-01-22')) * 100.0::DOUBLE / count(*) FILTER (ts < DATE '2024-01-22'), 4) END AS change_pct FROM events WHERE ts >= DATE '2024-01-15' AND ts < DATE '2024-01-29' GROUP BY 1")
def period_pair_change(spark, d):
    bounds = tuple(b.cast("timestamp_ntz") for b in dates.period_pair("weekly", F.lit(TODAY).cast("date")))
    return state.period_change(table(spark, d, "events"), F.col("ts").cast("timestamp_ntz"), bounds, ["event_type"])


@query("newly_detected_7d", "SELECT event_id FROM events WHERE date_diff('day', ts::DATE, DATE '2024-01-20') BETWEEN 0 AND 6")
def newly_detected_7d(spark, d):
    return table(spark, d, "events").where(dates.newly_seen(F.col("ts").cast("date"), F.lit("2024-01-20").cast("date"))).select("event_id")


@query("dashboard_filter_sort", "SELECT doc_id, lang, source, quality, row_number() OVER (ORDER BY quality DESC, n_chars DESC, source, doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND toxic = 0 AND contains(lower(text), 'tion') ORDER BY place LIMIT 100")
def dashboard_filter_sort(spark, d):
    rows = table(spark, d, "documents").where(F.col("lang").isin("en", "fr") & F.lower("text").contains("tion")).join(table(spark, d, "labels").where("toxic = 0"), "doc_id")
    return ranking.top(rows, 100, F.desc("quality"), F.desc("n_chars"), F.asc("source"), F.asc("doc_id")).select("doc_id", "lang", "source", "quality", F.col("rank").alias("place"))


@query("status_strip", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(DISTINCT source) AS sources, count(DISTINCT nullif(trim(lang), '')) AS langs, max(n_chars) AS longest FROM documents JOIN labels USING (doc_id)")
def status_strip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.countDistinct("source").alias("sources"), F.countDistinct(F.nullif(F.trim("lang"), F.lit(""))).alias("langs"), F.max("n_chars").alias("longest"))


@query("link_unique_1day", """
WITH p AS (SELECT o_orderkey, l_linenumber, o_orderkey * 10 + l_linenumber AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 30)
SELECT o_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS a, count(*) OVER (PARTITION BY line) AS b FROM p) WHERE a = 1 AND b = 1""")
def link_unique_1day(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("od"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("sd"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.abs(F.datediff("od", "sd")) <= 30)
    return linking.link_unique(orders, lines, on, "o_orderkey", "line").select("o_orderkey", "l_linenumber")


@query("interval_link_365d", "SELECT o_orderkey, count(*) AS n, min(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS nearest FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) BETWEEN 1 AND 365 GROUP BY 1")
def interval_link_365d(spark, d):
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & days.between(1, 365))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min(days).cast("long").alias("nearest"))


@query("asof_forward_first", """
SELECT e.event_id, arg_min(p.event_id, (p.ts, p.event_id)) AS hit_id FROM (SELECT * FROM events WHERE event_type = 'view') e
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts >= e.ts GROUP BY 1""")
def asof_forward_first(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'view'").drop("event_type")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))
    return linking.first_after(left, right, "user_id", "ts", "p_ts", "p_id").select("event_id", "hit_id")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return linking.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("streaks", """
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM r""")
def streaks(spark, d):
    return state.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "streak")


@query("carry_down", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def carry_down(spark, d):
    last = state.carried(None, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "signup", F.col("event_id")))
    return table(spark, d, "events").select("event_id", last.alias("section"))


_EDGES = "SELECT DISTINCT l_suppkey AS i, l_orderkey AS g FROM lineitem"
_CLOSURE = f"""WITH RECURSIVE e AS ({_EDGES}), nb AS (SELECT DISTINCT a.i AS x, b.i AS y FROM e a JOIN e b USING (g)),
c(i, r) AS (SELECT DISTINCT i, i FROM e UNION SELECT nb.y, c.r FROM c JOIN nb ON nb.x = c.i)"""


def _components(spark, d):
    edges = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    return linking.components(spark, edges, "l_suppkey", "l_orderkey")


@query("closure_components", _CLOSURE + " SELECT i AS l_suppkey, min(r) AS component FROM c GROUP BY 1")
def closure_components(spark, d):
    return _components(spark, d)


@query("closure_fingerprint", _CLOSURE + ", k AS (SELECT i, min(r) AS component FROM c GROUP BY 1) SELECT component, sha256(string_agg(s_suppkey || '|' || s_name || '|' || s_nationkey, chr(10) ORDER BY s_suppkey)) AS fingerprint FROM k JOIN supplier ON s_suppkey = i GROUP BY 1")
def closure_fingerprint(spark, d):
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return linking.fingerprints(_components(spark, d), suppliers, "l_suppkey", ["s_name", "s_nationkey"])


@query("full_outer_diff", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN b.quality IS DISTINCT FROM a.quality OR b.toxic IS DISTINCT FROM a.toxic THEN 'updated' ELSE 'same' END AS kind,
 CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.quality IS DISTINCT FROM a.quality THEN 'quality' END, CASE WHEN b.toxic IS DISTINCT FROM a.toxic THEN 'toxic' END) END AS changed
FROM (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 0) b FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 11 <> 0) a ON a.doc_id = b.doc_id""")
def full_outer_diff(spark, d):
    labels = table(spark, d, "labels")
    after = labels.where("doc_id % 11 <> 0").withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return compare.snapshot_diff(labels.where("doc_id % 7 <> 0"), after, "doc_id", ["quality", "toxic"])


@query("mode_with_tie", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def mode_with_tie(spark, d):
    return state.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query("shared_having", "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def shared_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n")).where("suppliers >= 2")


_H = "sha256('{}:' || doc_id)"


@query("stratified_sample", f"""
WITH r AS (SELECT doc_id, lang, source, {_H.format('s1')} AS h FROM documents),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) = 1 THEN 0 ELSE 1 END AS lead FROM r),
b AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY lead, h, doc_id) AS k FROM a)
SELECT doc_id, lang, source FROM b ORDER BY lead, k, n DESC, lang, source, h, doc_id LIMIT 60""")
def stratified_sample(spark, d):
    return ranking.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], ["lang", "source"], 60, "doc_id", "s1")


@query("risk_sample", f"""
WITH r AS (SELECT doc_id, source, {_H.format('r1')} AS h, (contains(text, '@'))::INT + (contains(text, 'http'))::INT + (n_chars > 4000)::INT AS risk, doc_id % 4 = 0 AS recent FROM documents),
lead AS (SELECT * FROM r ORDER BY recent DESC, risk DESC, h, doc_id LIMIT 20),
rest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS t FROM r WHERE doc_id NOT IN (SELECT doc_id FROM lead))
SELECT doc_id, source, 'risk' AS half FROM lead UNION ALL SELECT doc_id, source, 'spread' FROM (SELECT * FROM rest ORDER BY t, source LIMIT 20)""")
def risk_sample(spark, d):
    risk = F.col("text").contains("@").cast("int") + F.col("text").contains("http").cast("int") + (F.col("n_chars") > 4000).cast("int")
    rows = table(spark, d, "documents").select("doc_id", "source", risk.alias("risk"))
    return ranking.risk_sample(rows, F.col("risk"), F.col("doc_id") % 4 == 0, "source", 40, "doc_id", "r1").select("doc_id", "source", "half")


@query("hard_case_sample", "SELECT doc_id, signals FROM (SELECT doc_id, (contains(text, '@'))::INT + (contains(text, 'http'))::INT + (contains(text, 'token'))::INT + (n_chars > 5000)::INT + (lang <> 'en')::INT AS signals FROM documents) ORDER BY signals DESC, doc_id LIMIT 50")
def hard_case_sample(spark, d):
    t = F.col("text")
    signals = sum((c.cast("int") for c in (t.contains("@"), t.contains("http"), t.contains("token"), F.col("n_chars") > 5000, F.col("lang") != "en")), F.lit(0))
    return table(spark, d, "documents").select("doc_id", signals.alias("signals")).orderBy(F.desc("signals"), "doc_id").limit(50)


@query("source_cap_defer", """
WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents),
t AS (SELECT *, CASE WHEN place <= 80 AND row_number() OVER (PARTITION BY place <= 80, source ORDER BY place) <= 2 THEN 0 WHEN place <= 80 THEN 1 ELSE 2 END AS tier FROM p)
SELECT doc_id, new_place FROM (SELECT *, row_number() OVER (ORDER BY tier, place) AS new_place FROM t)""")
def source_cap_defer(spark, d):
    rows = ranking.ranked(table(spark, d, "documents").select("doc_id", "source", "n_chars"), F.col("n_chars"), F.asc("doc_id"))
    return ranking.capped_head(rows, "source", "rank", 80, 2).select("doc_id", "new_place")


@query("budget_prefix", "SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, sum((o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM orders) WHERE spent <= 50000000")
def budget_prefix(spark, d):
    rows = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return ranking.budget_prefix(rows, "cents", 50_000_000, [F.col("o_orderdate"), F.col("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderkey", "spent")


@query("near_dup_key", "SELECT doc_id, key FROM (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM (SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 120) AS key FROM documents)) WHERE n = 1")
def near_dup_key(spark, d):
    keys = table(spark, d, "documents").select("doc_id", text.near_key(F.col("text")).alias("key"))
    return keys.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "key")


@query("ngram_containment", """
SELECT page_id, len(g) AS n_grams, len(list_filter(g, lambda x: contains(html_body, x))) >= least(3, len(g)) AND len(g) > 0 AS contained FROM (
 SELECT page_id, html_body, list_distinct([substr(title, i, 7) for i in range(1, greatest(length(title) - 6, 0) + 1)]) AS g FROM (
  SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS html_body, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages))""")
def ngram_containment(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1).alias("body"), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return rows.select("page_id", F.size(text.grams(F.col("title"), 7)).cast("long").alias("n_grams"), text.contained(F.col("title"), F.col("body"), 7).alias("contained"))


@query("eval_rates", """
SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS good, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS toxic,
 round(avg(CASE WHEN lang = 'en' THEN CASE WHEN contains(text, 'tion') THEN 1.0::DOUBLE ELSE 0 END END) * 100, 6) AS worded FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def eval_rates(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return compare.rates(rows, ["source"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "worded": F.when(F.col("lang") == "en", F.col("text").contains("tion"))})


@query("rate_blockers", """
WITH r AS (SELECT lang, doc_id % 2 AS half, avg(toxic) AS t, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT a.lang, a.t > b.t AS toxic_worse, a.q < b.q AS quality_worse FROM r a JOIN r b ON a.lang = b.lang AND a.half = 1 AND b.half = 0""")
def rate_blockers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    half = F.col("doc_id") % 2
    r = rows.groupBy("lang").agg(*[F.avg(F.when(half == h, F.col(c))).alias(f"{c}{h}") for c in ("toxic", "quality") for h in (0, 1)]).where("toxic0 IS NOT NULL AND toxic1 IS NOT NULL")
    return r.select("lang", (F.col("toxic1") > F.col("toxic0")).alias("toxic_worse"), (F.col("quality1") < F.col("quality0")).alias("quality_worse"))


def _checks():
    return {"short": F.col("n_chars") < 200, "mail": F.col("text").contains("@"), "no_stop": ~F.col("text").contains("."), "secret": F.col("text").rlike("(?:token|password)")}


_FINDINGS = """SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN NOT contains(text, '.') THEN 'no_stop' END, CASE WHEN regexp_matches(text, 'token|password') THEN 'secret' END], lambda x: x IS NOT NULL)) AS "check" FROM documents"""


@query("audit_findings", _FINDINGS)
def audit_findings(spark, d):
    return compare.findings(table(spark, d, "documents"), "doc_id", _checks())


@query("audit_breaker", f"""WITH p AS (SELECT doc_id, min(CASE "check" WHEN 'secret' THEN 'withhold' WHEN 'mail' THEN 'review' ELSE 'zz_note' END) AS action FROM ({_FINDINGS}) GROUP BY 1)
SELECT doc_id, action FROM p WHERE NOT (action = 'review' AND (SELECT count(*) FROM p WHERE action = 'review') > 15)""")
def audit_breaker(spark, d):
    action = F.when(F.col("check") == "secret", "withhold").when(F.col("check") == "mail", "review").otherwise("zz_note")
    plan = compare.findings(table(spark, d, "documents"), "doc_id", _checks()).groupBy("doc_id").agg(F.min(action).alias("action"))
    held = plan.groupBy("action").count().where((F.col("action") == "review") & (F.col("count") > 15)).select(F.col("action").alias("a"))
    return plan.join(held, F.col("action") == F.col("a"), "left_anti")


@query("daily_cohort_matrix", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase
FROM (SELECT (DATE '2024-02-05' - i::INT)::DATE AS day FROM range(14) t(i)) LEFT JOIN events ON ts::DATE = day GROUP BY 1""")
def daily_cohort_matrix(spark, d):
    out = state.cohort_matrix(table(spark, d, "events"), F.col("ts").cast("date"), "event_type", ["signup", "view", "purchase"], F.lit("2024-02-05").cast("date"), 14)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("set_ops", "SELECT 'idle' AS kind, c_custkey AS key FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_ops(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    idle = customers.select("c_custkey").subtract(orders.select("o_custkey"))
    both = customers.where("c_acctbal > 0").select("c_custkey").intersect(orders.where("o_orderstatus = 'F'").select("o_custkey"))
    return idle.select(F.lit("idle").alias("kind"), F.col("c_custkey").alias("key")).union(both.select(F.lit("both"), "c_custkey"))


@query("symmetric_difference", "SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = k WHERE k IS NULL UNION ALL SELECT k FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = k WHERE l_partkey IS NULL")
def symmetric_difference(spark, d):
    flags = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("n"))
    return flags.where("n = 1").select("l_partkey")


@query("title_gate_reasons", """
SELECT page_id, array_to_string(list_filter([CASE WHEN length(t) = 0 THEN 'empty' END, CASE WHEN length(t) > 80 THEN 'long' END, CASE WHEN contains(t, '***') THEN 'markup' END, CASE WHEN regexp_matches(t, '^[a-z]') THEN 'lower' END, CASE WHEN ends_with(t, '.') THEN 'stop' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)""")
def title_gate_reasons(spark, d):
    t = F.col("t")
    checks = {"empty": F.length(t) == 0, "long": F.length(t) > 80, "markup": t.contains("***"), "lower": t.rlike("^[a-z]"), "stop": t.endswith(".")}
    rows = table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("t"))
    return rows.select("page_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])), ",").alias("reasons"))


@query("json_fields", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(spark, d):
    row = F.from_json("props", "k bigint, missing string")
    return table(spark, d, "events").select("event_id", row["k"].alias("k"), row["missing"].alias("missing"))


@query("csv_guard_projection", r"""SELECT c_custkey, '"' || replace(CASE WHEN regexp_matches(v, '^[\x20\x09-\x0D]*[=+@\x09\x0D-]') THEN '''' || v ELSE v END, '"', '""') || '"' AS cell FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name WHEN c_custkey % 3 = 1 THEN ' -"' || c_mktsegment ELSE c_name END AS v FROM customer)""")
def csv_guard_projection(spark, d):
    v = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(' -"'), "c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.csv_cell(v).alias("cell"))


@query("turn_alignment", "SELECT a.conv_id, a.turn, length(a.text) AS user_chars, length(b.text) AS reply_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def turn_alignment(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    rows = rows.withColumn("next", F.lead(F.struct("turn", "role", "n")).over(w))
    rows = rows.where((F.col("role") == "user") & (F.col("next.role") == "assistant") & (F.col("next.turn") == F.col("turn") + 1))
    return rows.select("conv_id", "turn", F.col("n").cast("long").alias("user_chars"), F.col("next.n").cast("long").alias("reply_chars"))


@query("neighbour_links", "SELECT conv_id, turn, lag(turn) OVER w AS older, lead(turn) OVER w AS newer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_links(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("older"), F.lead("turn").over(w).alias("newer"))


@query("unsupported_numbers", "SELECT a.item_id, array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(a.text || ' ' || a.item_id, '[0-9]+'))), lambda x: NOT contains(a.text, x)), ',') AS numbers FROM benchmark a")
def unsupported_numbers(spark, d):
    out = text.unsupported_numbers(F.concat_ws(" ", "text", F.col("item_id").cast("string")), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(out), ",").alias("numbers"))


@query("deadline_states", """
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY + INTERVAL 15 HOUR <= TIMESTAMP '2000-01-01 00:00:00' THEN 'Closed' ELSE 'Open for Comment' END AS stage,
 strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS last_day FROM orders""")
def deadline_states(spark, d):
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")
    stage = dates.resolve_stage(F.lit("Open for Comment"), end, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", stage.alias("stage"), F.date_format(dates.last_day(end), "yyyy-MM-dd").alias("last_day"))


@query("cost_rollup", "SELECT lang, count(*) AS n, round(sum((n_chars * 1.1 * 3.0 + 700 * 15.0) / 1e6 * 0.5), 6) AS bound FROM documents GROUP BY 1")
def cost_rollup(spark, d):
    cost = hashing.cost_bound(F.col("n_chars"), F.lit(700), 3.0, 15.0, batch=True)
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("bound"))


@query("duplicate_titles", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name, p_type) > 1 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS title FROM part")
def duplicate_titles(spark, d):
    rows = table(spark, d, "part").withColumn("key", F.concat_ws("|", "p_name", "p_type"))
    n = F.count("*").over(Window.partitionBy("key"))
    return rows.select("p_partkey", F.when(n > 1, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_name")).alias("title"))


@query("field_mask", "SELECT page_id, (contains(url, '?'))::INT + 2 * (contains(url, '#'))::INT + 4 * (starts_with(url, 'https'))::INT AS mask FROM pages")
def field_mask(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", hashing.mask([u.contains("?"), u.contains("#"), u.startswith("https")]).alias("mask"))


@query("percent_share", "SELECT source, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY 1")
def percent_share(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query("carry_forward", "SELECT n.doc_id, coalesce(o.quality, n.quality) AS quality, n.toxic FROM labels n LEFT JOIN (SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 2 = 0) o ON o.doc_id = n.doc_id AND o.toxic = n.toxic")
def carry_forward(spark, d):
    labels = table(spark, d, "labels")
    old = labels.where("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality"))
    return publish.carried_forward(labels, old, "doc_id", "toxic", ["quality"])


@query("candidate_reason", "SELECT doc_id, CASE WHEN lang IS NULL THEN 'missing' WHEN n_chars < 300 THEN 'short' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'token') THEN 'secret' END AS reason FROM documents")
def candidate_reason(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", compare.first_reason([("missing", F.col("lang").isNull()), ("short", F.col("n_chars") < 300), ("contact", t.contains("@")), ("secret", t.contains("token"))]).alias("reason"))


_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("rss_items", f"""SELECT o_orderkey, '<item><title>' || {_XML.format("o_orderpriority || ' ' || o_orderstatus")} || '</title><link>' || {_XML.format("'https://example.org/?a=1&o=' || o_orderkey")} || '</link><guid isPermaLink="false">' || o_orderkey
 || '</guid><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>' AS item FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def rss_items(spark, d):
    return feeds_out.rss_items(table(spark, d, "orders").withColumn("title", F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).withColumn("link", F.concat(F.lit("https://example.org/?a=1&o="), "o_orderkey")), "title", "link", "o_orderdate", "o_orderkey")


@query("ics_events")
def ics_events(spark, d):
    return feeds_out.ics_events(table(spark, d, "benchmark"), "item_id", "text", F.lit("2024-03-01").cast("date"))
