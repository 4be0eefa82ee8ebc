"""Further queries: health, links, caches, ledgers, nested documents, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numerals, text
from ..operators import caches, deadlines, documents, evidence, health, ledger, ranking, state, timeline
from ..sources import markup
from ..sources.shared import shared_path
from ..sources.tables import table
from ..streaming import twins
from .catalog import query

_REPORT = """SELECT 'n' || s_nationkey AS source_key, CASE WHEN s_suppkey % 5 = 0 THEN 'error' WHEN s_suppkey % 17 = 0 THEN 'odd' ELSE 'success' END AS status, s_suppkey - 2 AS fetched_count, s_suppkey % 3 AS new_count, CASE WHEN s_suppkey % 10 = 0 THEN 'timeout' END AS error_type FROM supplier"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 5 == 0, "error").when(k % 17 == 0, "odd").otherwise("success")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("n"), "s_nationkey").alias("source_key"), status.alias("status"), (k - 2).alias("fetched_count"), (k % 3).alias("new_count"), F.when(k % 10 == 0, "timeout").alias("error_type"),
    )


@query("source_report_problems", f"""
WITH r AS ({_REPORT}), s AS (SELECT 'n' || n_nationkey AS k FROM nation WHERE n_nationkey < 22), n AS (SELECT source_key, count(*) AS n FROM r GROUP BY 1)
SELECT DISTINCT source_key, problem FROM (
 SELECT k AS source_key, 'missing' AS problem FROM s WHERE k NOT IN (SELECT source_key FROM n)
 UNION ALL SELECT source_key, 'unknown' FROM n WHERE source_key NOT IN (SELECT k FROM s)
 UNION ALL SELECT source_key, 'duplicate' FROM n WHERE n > 1
 UNION ALL SELECT source_key, 'status' FROM r WHERE status NOT IN ('success', 'error')
 UNION ALL SELECT source_key, 'fetched_count' FROM r WHERE fetched_count < 0
 UNION ALL SELECT source_key, 'error_type' FROM r WHERE status = 'error' AND error_type IS NULL)""")
def source_report_problems(spark, d):
    sources = table(spark, d, "nation").where("n_nationkey < 22").select(F.concat(F.lit("n"), "n_nationkey").alias("source_key"))
    return health.report_problems(_report(spark, d), sources)


_DAY = "SELECT event_type AS source_key, count(*) FILTER (user_id < 20) AS n FROM events WHERE ts::DATE = DATE '{}' GROUP BY 1"


@query("source_health_state", f"""
WITH r AS ({_DAY.format('2024-01-11')}), p AS ({_DAY.format('2024-01-10')})
SELECT r.source_key, CASE WHEN r.n % 4 <> 1 AND r.n % 3 = 0 THEN coalesce(p.n % 3, 0) + 1 ELSE 0 END AS consecutive_zero_runs, CASE WHEN r.n % 4 = 1 THEN coalesce(p.n % 2, 0) + 1 ELSE 0 END AS consecutive_error_runs,
 CASE WHEN r.n % 4 = 1 THEN 'error' WHEN r.n % 3 = 0 THEN 'zero' ELSE 'healthy' END AS last_status,
 CASE WHEN r.n % 4 = 1 OR r.n % 3 = 0 THEN '2024-01-11' END AS last_problem_at,
 CASE WHEN NOT (r.n % 4 = 1 OR r.n % 3 = 0) AND (coalesce(p.n % 3, 0) > 0 OR coalesce(p.n % 2, 0) > 0) THEN '2024-01-11' END AS last_recovered_at
FROM r LEFT JOIN p USING (source_key)""")
def source_health_state(spark, d):
    def day(on):
        rows = table(spark, d, "events").where(F.col("ts").cast("date") == F.lit(on).cast("date"))
        return rows.groupBy(F.col("event_type").alias("source_key")).agg(F.count_if(F.col("user_id") < 20).alias("n"))

    n = F.col("n")
    report = day("2024-01-11").select("source_key", F.when(n % 4 == 1, "error").otherwise("success").alias("status"), (n % 3).alias("fetched_count"))
    none = F.lit(None).cast("string")
    previous = day("2024-01-10").select("source_key", (n % 3).alias("consecutive_zero_runs"), (n % 2).alias("consecutive_error_runs"), none.alias("last_problem_at"), none.alias("last_recovered_at"))
    return health.next_state(report, previous, "2024-01-11")


@query("propagate_deadlines", """
WITH t AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS day FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS day, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') END AS deadline, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'),
m AS (SELECT t.id, s.id AS sid, s.deadline, count(*) OVER (PARTITION BY s.id) AS back FROM t JOIN s ON t.k = s.k AND abs(date_diff('day', t.day::DATE, s.day::DATE)) <= 60),
g AS (SELECT id, count(*) AS n, count(DISTINCT nullif(deadline, 'soon')) AS dl, count(*) FILTER (deadline = 'soon') AS bad, max(back) AS back, min(sid) AS sid, min(deadline) AS deadline FROM m GROUP BY 1),
o AS (SELECT t.id, CASE WHEN n IS NULL THEN 'none' WHEN bad > 0 THEN 'invalid' WHEN dl > 1 THEN 'conflicting' WHEN n > 1 OR back > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, sid, deadline FROM t LEFT JOIN g USING (id))
SELECT id, outcome, CASE WHEN outcome = 'matched' THEN sid END AS source_id, CASE WHEN outcome = 'matched' THEN deadline END AS deadline FROM o""")
def propagate_deadlines(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    targets = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), "day")
    end = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format(F.date_add("day", 40), "yyyy-MM-dd"))
    sources = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), "day", end.alias("deadline"), F.col("o_orderpriority").alias("p"))
    return deadlines.propagate(targets, sources, "k", "day", F.col("s_p") != "5-LOW", 60)


@query("deadlines_within_horizon", """
SELECT o_orderkey, date_diff('day', DATE '1998-06-01', (o_orderdate + INTERVAL 30 DAY)::DATE) AS days_left FROM orders
WHERE o_orderdate + INTERVAL 30 DAY + INTERVAL 15 HOUR > TIMESTAMP '1998-06-01 00:00:00' AND date_diff('day', DATE '1998-06-01', (o_orderdate + INTERVAL 30 DAY)::DATE) BETWEEN 0 AND 7""")
def deadlines_within_horizon(spark, d):
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")
    rows = table(spark, d, "orders").withColumn("deadline", end)
    out = deadlines.open_soon(rows, "deadline", F.lit("1998-06-01 00:00:00").cast("timestamp"), F.lit("1998-06-01").cast("date"), 7)
    return out.select("o_orderkey", F.col("days_left").cast("long").alias("days_left"))


@query("select_new_items", "SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-10' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def select_new_items(spark, d):
    events = table(spark, d, "events").withColumn("seen", F.date_format("ts", "yyyy-MM-dd"))
    return deadlines.seen_on(events, "seen", F.lit("2024-01-10").cast("date"), 2, events.where("event_id % 3 = 0"), "event_id").select("event_id")


_NAMED = "SELECT o_orderkey AS id, o_custkey || '-' || year(o_orderdate) AS name, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = '{}'"


def _named(spark, d, status, name):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"), name(day).alias("name"), day.alias("day"))


def _by_year(day):
    return F.concat_ws("-", "o_custkey", F.year(day))


@query("link_drafts", f"""
WITH d AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM ({_NAMED.format('O')})) WHERE c = 1), a AS ({_NAMED.format('F')}),
p AS (SELECT d.id, a.id AS act_id FROM d JOIN a ON a.name = d.name AND abs(year(d.day) - year(a.day)) <= 1 AND abs(date_diff('day', d.day, a.day)) <= 100)
SELECT id, act_id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, count(*) OVER (PARTITION BY act_id) AS m FROM p) WHERE n = 1 AND m = 1""")
def link_drafts(spark, d):
    return timeline.link_drafts(_named(spark, d, "O", _by_year), _named(spark, d, "F", _by_year), 1, 100)


@query("link_consultations", f"""
WITH c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM ({_NAMED.format('P')})) WHERE c = 1), a AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM ({_NAMED.format('F')})) WHERE c = 1)
SELECT c.id, a.id AS act_id, date_diff('day', c.day, a.day) AS days FROM c JOIN a ON a.name = c.name AND date_diff('day', c.day, a.day) BETWEEN 1 AND 365""")
def link_consultations(spark, d):
    out = timeline.link_consultations(_named(spark, d, "P", _by_year), _named(spark, d, "F", _by_year))
    return out.withColumn("days", F.col("days").cast("long"))


@query("timeline_order", """
WITH e AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS day, o_orderpriority AS p, o_orderstatus = 'F' AS anchor FROM orders),
a AS (SELECT *, coalesce(day, min(day) FILTER (anchor) OVER (PARTITION BY k), min(day) OVER (PARTITION BY k)) AS at_, count(*) OVER (PARTITION BY k) AS n FROM e)
SELECT id, row_number() OVER (PARTITION BY k ORDER BY at_ ASC NULLS LAST, p, id) AS place FROM a WHERE n >= 2""")
def timeline_order(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "F").alias("anchor"))
    return timeline.ordered_events(timeline.with_several(e, "k"), "k", "day", "p", F.col("anchor")).select("id", "place")


@query("cache_split", "SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS hit, l.quality AS value FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id")
def cache_split(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("value"), "toxic")
    return caches.split(rows, cache, ["id"], F.col("c_toxic") == 0)


@query("cache_upsert", """
WITH old AS (SELECT doc_id AS id, quality AS value, toxic = 1 AS reviewed FROM labels WHERE doc_id % 2 = 0), new AS (SELECT doc_id AS id, 5 AS value, false AS reviewed FROM labels WHERE doc_id % 3 = 0)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NOT NULL AND (old.reviewed OR new.id IS NULL) THEN old.value ELSE new.value END AS value, CASE WHEN old.id IS NOT NULL AND (old.reviewed OR new.id IS NULL) THEN old.reviewed ELSE new.reviewed END AS reviewed
FROM old FULL JOIN new ON old.id = new.id""")
def cache_upsert(spark, d):
    labels = table(spark, d, "labels")
    old = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("value"), (F.col("toxic") == 1).alias("reviewed"))
    new = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(5).alias("value"), F.lit(False).alias("reviewed"))
    return caches.upsert(old, new, ["id"], replace=True)


@query("admission_routes", "SELECT id, CASE WHEN hit THEN 'apply' WHEN row_number() OVER (PARTITION BY hit ORDER BY id) <= 100 THEN 'compute' ELSE 'skip' END AS route FROM (SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents)")
def admission_routes(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    have = table(spark, d, "labels").select(F.col("doc_id").alias("l"))
    rows = rows.join(have, F.col("id") == F.col("l"), "left").select("id", F.col("l").isNull().alias("miss"))
    return caches.admitted(rows, F.col("miss"), [F.col("id")], 100).select("id", "route")


@query("attempt_counters", "SELECT f.doc_id AS id, coalesce(s.quality, 0)::BIGINT + (f.doc_id % 2 = 0)::INT AS n FROM labels f LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0) s USING (doc_id) WHERE f.toxic = 1 AND coalesce(s.quality, 0) + (f.doc_id % 2 = 0)::INT > 0")
def attempt_counters(spark, d):
    labels = table(spark, d, "labels")
    s = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("n"))
    return caches.attempts(s, labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), labels.where("toxic = 1").select(F.col("doc_id").alias("id")))


_FOUND = """SELECT doc_id AS id, 'mail' AS "check" FROM documents WHERE contains(text, '@') UNION ALL SELECT doc_id, 'secret' FROM documents WHERE contains(text, 'token') UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 300"""


@query("audit_plan", f"""
SELECT id, CASE WHEN min(CASE "check" WHEN 'secret' THEN 0 WHEN 'mail' THEN 1 ELSE 2 END) = 0 THEN 'withhold' WHEN min(CASE "check" WHEN 'secret' THEN 0 WHEN 'mail' THEN 1 ELSE 2 END) = 1 THEN 'correct' WHEN id % 5 >= 3 THEN 'parked' ELSE 'requeue' END AS action, string_agg("check", ',' ORDER BY "check") AS checks FROM ({_FOUND}) GROUP BY id""")
def audit_plan(spark, d):
    docs = table(spark, d, "documents").withColumn("id", F.col("doc_id"))
    found = docs.select("id", F.explode(documents.errors({"mail": F.col("text").contains("@"), "secret": F.col("text").contains("token"), "short": F.col("n_chars") < 300})).alias("check"))
    policy = spark.createDataFrame([("secret", "withhold"), ("mail", "correct"), ("short", "requeue")], "check string, action string")
    return caches.planned(found, policy, docs.select("id", (F.col("id") % 5).alias("n")), 3)


@query("stage_ledger", """
WITH c AS (SELECT doc_id AS key, 1 + doc_id % 3 AS at_ FROM labels WHERE doc_id % 4 <> 0), p AS (SELECT doc_id AS key, quality AS best, '2024-01-01' AS queued, CASE WHEN quality = 1 THEN '2024-01-02' END AS drafted FROM labels WHERE doc_id % 5 <> 0)
SELECT coalesce(c.key, p.key) AS key, greatest(at_, best)::INT AS best, coalesce(queued, CASE WHEN at_ >= 0 THEN '2024-03-01' END) AS queued, coalesce(drafted, CASE WHEN at_ >= 1 THEN '2024-03-01' END) AS drafted, CASE WHEN at_ >= 2 THEN '2024-03-01' END AS merged, CASE WHEN at_ >= 3 THEN '2024-03-01' END AS live FROM c FULL JOIN p ON c.key = p.key""")
def stage_ledger(spark, d):
    labels = table(spark, d, "labels").withColumn("key", F.col("doc_id"))
    stages = ["queued", "drafted", "merged", "live"]
    none = F.lit(None).cast("string")
    previous = labels.where("doc_id % 5 <> 0").select("key", F.col("quality").alias("best"), F.lit("2024-01-01").alias("queued"), F.when(F.col("quality") == 1, "2024-01-02").alias("drafted"), none.alias("merged"), none.alias("live"))
    current = labels.where("doc_id % 4 <> 0").select("key", F.element_at(F.array(*[F.lit(s) for s in stages]), (2 + F.col("doc_id") % 3).cast("int")).alias("stage"))
    return ledger.stamped(previous, current, stages, F.lit("2024-03-01"))


@query("slot_plan", """
WITH t AS (SELECT doc_id AS id, 0 AS tier, n_chars AS n FROM documents WHERE contains(text, 'token') UNION ALL SELECT doc_id, 1, n_chars FROM documents WHERE contains(text, '@') UNION ALL SELECT doc_id, 2, n_chars FROM documents WHERE lang = 'de'),
b AS (SELECT id, min(tier) AS tier, any_value(n) AS n FROM t GROUP BY 1) SELECT id, tier FROM b ORDER BY tier, n DESC, id LIMIT 30""")
def slot_plan(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), "text", "lang")
    tiers = [docs.where(F.col("text").contains("token")), docs.where(F.col("text").contains("@")), docs.where("lang = 'de'")]
    return ledger.slots([t.select("id", "n") for t in tiers], "id", [F.desc("n"), F.asc("id")], 30).select("id", "tier")


@query("workflow_actions", "SELECT source AS workflow, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS keys, string_agg(DISTINCT lang, ',' ORDER BY lang) AS reasons FROM documents WHERE n_chars < 400 GROUP BY 1")
def workflow_actions(spark, d):
    rows = table(spark, d, "documents").where("n_chars < 400").select(F.col("source").alias("workflow"), F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("reason"))
    return ledger.collapsed(rows)


@query("stamp_if_changed", "SELECT n.doc_id, n.toxic, CASE WHEN o.doc_id IS NOT NULL AND o.toxic = n.toxic THEN '2024-01-01' ELSE '2024-02-02' END AS stamp FROM labels n LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 2 = 0) o USING (doc_id)")
def stamp_if_changed(spark, d):
    labels = table(spark, d, "labels")
    old = labels.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"), F.lit("2024-01-01").alias("stamp"))
    return ledger.stamp_if_changed(labels.select("doc_id", "toxic", F.lit("2024-02-02").alias("stamp")), old, "doc_id", ["toxic"], "stamp")


@query("provision_diff", r"""
WITH o AS (SELECT item_id::VARCHAR AS path, text FROM benchmark WHERE item_id % 7 <> 0), n AS (SELECT item_id::VARCHAR AS path, CASE WHEN item_id % 5 = 0 THEN text || ' (see 12)' WHEN item_id % 3 = 0 THEN upper(text) ELSE text END AS text FROM benchmark WHERE item_id % 11 <> 0)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN regexp_replace(o.text, ' \(see [0-9]+\)', '', 'g') = regexp_replace(n.text, ' \(see [0-9]+\)', '', 'g') THEN 'citation' ELSE 'substantive' END AS kind
FROM o FULL JOIN n ON o.path = n.path WHERE o.text IS DISTINCT FROM n.text""")
def provision_diff(spark, d):
    b = table(spark, d, "benchmark").withColumn("path", F.col("item_id").cast("string"))
    changed = F.when(F.col("item_id") % 5 == 0, F.concat("text", F.lit(" (see 12)"))).when(F.col("item_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    return documents.provision_diff(b.where("item_id % 7 <> 0").select("path", "text"), b.where("item_id % 11 <> 0").select("path", changed.alias("text")), r" \(see [0-9]+\)")


@query("size_ladder", "SELECT doc_id, length(CASE WHEN strlen(substr(text, 1, 900)) <= 930 THEN substr(text, 1, 900) WHEN strlen(substr(text, 1, 500)) <= 930 THEN substr(text, 1, 500) ELSE substr(text, 1, 250) END) AS n FROM documents")
def size_ladder(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(documents.fitted(F.col("text"), (900, 500, 250), 930)).cast("long").alias("n"))


@query("weekly_buckets", """
WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS monday, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT strftime(monday, '%Y-%m-%d') AS week, n FROM w WHERE n >= 5 AND monday > DATE '1996-01-01' AND monday + 7 <= DATE '2001-06-01'""")
def weekly_buckets(spark, d):
    monday = dates.week_monday(F.col("o_orderdate").cast("date"))
    rows = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(monday.alias("m")).agg(F.count("*").alias("n"))
    return rows.where((F.col("n") >= 5) & (F.col("m") > F.lit("1996-01-01").cast("date")) & (F.date_add("m", 7) <= F.lit("2001-06-01").cast("date"))).select(F.date_format("m", "yyyy-MM-dd").alias("week"), "n")


@query("digest_fan_out", """
WITH o AS (SELECT c_mktsegment AS channel, o_orderkey, o_orderdate::DATE AS day, date_diff('day', DATE '1998-06-01', o_orderdate::DATE + 30) AS left_ FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT channel, count(*) FILTER (day = DATE '1998-06-01') AS new_items, count(*) FILTER (left_ IN (0, 3, 7)) AS reminders FROM o GROUP BY 1 HAVING count(*) FILTER (day = DATE '1998-06-01') > 0 OR count(*) FILTER (left_ IN (0, 3, 7)) > 0""")
def digest_fan_out(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day, today = F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date")
    left = F.datediff(F.date_add(day, 30), today)
    out = rows.groupBy(F.col("c_mktsegment").alias("channel")).agg(F.count_if(day == today).alias("new_items"), F.count_if(left.isin(0, 3, 7)).alias("reminders"))
    return out.where("new_items > 0 OR reminders > 0")


@query("trailing_windows", "SELECT event_type, count(*) FILTER (ts >= DATE '2024-01-24') AS last_7, count(*) AS last_14 FROM events WHERE ts >= DATE '2024-01-17' AND ts < DATE '2024-01-31' GROUP BY 1")
def trailing_windows(spark, d):
    bounds = tuple(F.lit(x).cast("timestamp_ntz") for x in ("2024-01-17", "2024-01-24", "2024-01-31"))
    out = state.period_change(table(spark, d, "events"), F.col("ts").cast("timestamp_ntz"), bounds, ["event_type"])
    return out.select("event_type", F.col("now").alias("last_7"), (F.col("now") + F.col("before")).alias("last_14"))


@query("browser_sort_modes", "SELECT 'longest' AS mode, doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) UNION ALL SELECT 'source', doc_id FROM (SELECT doc_id FROM documents ORDER BY source, n_chars DESC, doc_id LIMIT 50) UNION ALL SELECT 'newest', doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50)")
def browser_sort_modes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    modes = {"longest": [F.desc("n_chars"), F.asc("doc_id")], "source": [F.asc("source"), F.desc("n_chars"), F.asc("doc_id")], "newest": [F.desc("doc_id")]}
    out = None
    for name, order in modes.items():
        page = ranking.top(docs, 50, *order).select(F.lit(name).alias("mode"), "doc_id")
        out = page if out is None else out.union(page)
    return out


@query("first_sentence", r"SELECT doc_id, regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1) AS line FROM documents")
def first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"^([^.!?\n]*[.!?]?)", 1).alias("line"))


@query("shortened_titles", r"""
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN contains(h, ' ') AND length(regexp_replace(h, ' [^ ]*$', '')) + 1 >= 73 THEN rtrim(regexp_replace(h, ' [^ ]*$', '')) ELSE rtrim(h) END AS title
FROM (SELECT doc_id, t, substr(t, 1, 120) AS h FROM (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents))""")
def shortened_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shorten_title(text.collapse(F.col("text"))).alias("title"))


@query("escaped_html", "SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS url FROM pages")
def escaped_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.escape_html(F.col("url")).alias("url"))


_KEY = r"replace(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}\p{Z}\p{C}]', '', 'g'), 'ß', 'ss')"


@query("title_keys", f"SELECT item_id, {_KEY} AS key, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM benchmark")
def title_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.title_key(F.col("text")).alias("key"), text.clean_markup(F.col("text")).alias("plain"))


@query("text_change_spans")
def text_change_spans(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.explode(text.change_spans(F.col("text"), F.replace(F.col("text"), F.lit(" the "), F.lit(" a ")))).alias("s")).select("item_id", "s.*")


_LEAD = ("", "", "二", "三", "四", "五", "六", "七", "八", "九")
_ONES = ("", "一", *_LEAD[2:])
_PARTS = "CASE WHEN n >= 100 THEN {lead}[n // 100 + 1] || '百' ELSE '' END || CASE WHEN n // 10 % 10 > 0 THEN {lead}[n // 10 % 10 + 1] || '十' ELSE '' END || {ones}[n % 10 + 1]".format(lead=list(_LEAD), ones=list(_ONES))


@query("kanji_numerals", f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS n FROM orders),
t AS (SELECT k, n, CASE WHEN k % 50 = 0 THEN '元' WHEN k % 4 = 0 THEN {_PARTS} WHEN k % 4 = 1 THEN translate(k::VARCHAR, '0123456789', '〇一二三四五六七八九') WHEN k % 4 = 2 THEN k::VARCHAR ELSE 'x' || k END AS t FROM o),
v AS (SELECT *, CASE WHEN k % 50 = 0 OR k % 4 = 3 THEN NULL WHEN k % 4 = 0 THEN nullif(n, 0) ELSE k END AS v FROM t)
SELECT k AS o_orderkey, t, CASE WHEN k % 4 <> 1 OR k < 10 THEN v END AS short, CASE WHEN k % 50 = 0 THEN 1 ELSE v END AS free, v AS strict FROM v""")
def kanji_numerals(spark, d):
    key = F.col("o_orderkey")
    n, of = key % 1000, lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    tens = F.floor(n / 10) % 10
    units = F.concat(F.when(n >= 100, F.concat(of(_LEAD, F.floor(n / 100)), F.lit("百"))).otherwise(""), F.when(tens > 0, F.concat(of(_LEAD, tens), F.lit("十"))).otherwise(""), of(_ONES, n % 10))
    placed, plain = F.translate(key.cast("string"), "0123456789", numerals.DIGITS), key.cast("string")
    t = F.when(key % 50 == 0, "元").when(key % 4 == 0, units).when(key % 4 == 1, placed).when(key % 4 == 2, plain).otherwise(F.concat(F.lit("x"), plain))
    rows = table(spark, d, "orders").select(key, t.alias("t"))
    return rows.select(key, "t", numerals.short_number("t").alias("short"), numerals.free_number("t").alias("free"), numerals.strict_number("t").alias("strict"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    rows = _stream(spark, d).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return twins.run_once(spark, twins.first_seen(rows, "key", "ts"), shared_path(spark, "stream")).select("user_id", "event_type")


@query("stream_weekly", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly(spark, d):
    out = twins.run_once(spark, twins.weekly(_stream(spark, d), "ts", "event_type"), shared_path(spark, "stream"), "update")
    return out.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n")


@query("stream_streaks", """
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, max((ts, event_id)) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id::VARCHAR AS key, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_bad FROM r JOIN (SELECT user_id AS u, arg_max(run, (ts, event_id)) AS lr FROM r GROUP BY 1) ON u = user_id AND run = lr GROUP BY 1""")
def stream_streaks(spark, d):
    out = twins.run_once(spark, twins.streak_updates(_stream(spark, d), "user_id", "ts", "event_id", "event_type = 'error'"), shared_path(spark, "stream"), "update")
    return out.select("key", "n_bad")


@query("page_main_text")
def page_main_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.page_text(F.col("html")).alias("text"))


@query("lookback_days", "SELECT strftime(DATE '2024-03-02' - i::INT, '%Y-%m-%d') AS day FROM range(1, 8) t(i)")
def lookback_days(spark, d):
    days = dates.lookback(F.lit("2024-03-02").cast("date"), 7)
    return spark.range(1).select(F.explode(days).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("law_stage_by_dates", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 60 DAY <= DATE '1998-01-01' THEN 'In Force' WHEN o_orderkey % 3 > 0 THEN 'Scheduled to Take Effect' WHEN o_orderdate <= DATE '1998-01-01' THEN 'Promulgated' END AS stage FROM orders WHERE o_orderkey % 3 > 0 OR o_orderdate + INTERVAL 60 DAY > DATE '1998-01-01'")
def law_stage_by_dates(spark, d):
    day, today = F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")
    effective = F.when(F.col("o_orderkey") % 3 > 0, F.date_add(day, 60))
    rows = table(spark, d, "orders").where((F.col("o_orderkey") % 3 > 0) | (F.date_add(day, 60) > today))
    return rows.select("o_orderkey", dates.stage_by_dates(day, effective, today).alias("stage"))


@query("search_haystack", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(10), source, lang, text)), 'src1' || chr(10) || 'en')")
def search_haystack(spark, d):
    return table(spark, d, "documents").where(text.haystack(F.col("source"), F.col("lang"), F.col("text")).contains("src1\nen")).select("doc_id")


@query("inverted_notes", "SELECT id, array_to_string(list_transform(list_sort(list(DISTINCT n)), lambda x: x::VARCHAR), ',') AS notes FROM (SELECT l_partkey AS id, l_orderkey AS n FROM lineitem) GROUP BY 1")
def inverted_notes(spark, d):
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return evidence.inverted(orders, "l_orderkey", F.col("parts"))


@query("recent_or_requested", "SELECT o_orderkey, o_orderkey % 100 = 0 AND o_orderstatus <> 'F' AS missing FROM orders WHERE o_orderdate >= DATE '2001-07-01' OR o_orderkey % 100 = 0")
def recent_or_requested(spark, d):
    orders = table(spark, d, "orders")
    asked = orders.where("o_orderkey % 100 = 0").select("o_orderkey")
    return evidence.recent_or_requested(orders, F.col("o_orderdate").cast("date"), F.lit("2001-07-01").cast("date"), "o_orderkey", asked, F.col("o_orderstatus") == "F").select("o_orderkey", "missing")


@query("canary_rows", """
WITH f AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 <> 0),
a AS (SELECT doc_id, 'zz' AS lang, 'lang' AS defect FROM f WHERE lang = 'en' ORDER BY sha256('c:lang:' || doc_id), doc_id LIMIT 5),
b AS (SELECT doc_id, upper(lang) AS lang, 'upper' AS defect FROM f WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY sha256('c:upper:' || doc_id), doc_id LIMIT 5)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def canary_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    defects = [("lang", F.col("lang") == "en", F.lit("zz")), ("upper", F.col("n_chars") > 500, F.upper("lang"))]
    return evidence.canaries(docs, docs.where("doc_id % 10 = 0"), "doc_id", defects, "lang", 5, "c").select("doc_id", "lang", "defect")


@query("next_actions", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'collect more' WHEN lang = 'en' THEN 'review' ELSE 'translate' END AS action FROM documents")
def next_actions(spark, d):
    stage = ledger.stage_ladder([("thin", F.col("n_chars") >= 300), ("foreign", F.col("lang") == "en")], "ready")
    return table(spark, d, "documents").select("doc_id", evidence.next_action(stage, {"thin": "collect more", "foreign": "translate"}, "review").alias("action"))


@query("fallback_names", "SELECT page_id, h || CASE WHEN split_part(h, '.', 1) <> h THEN '|' || split_part(h, '.', 1) ELSE '' END AS names FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)")
def fallback_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(evidence.shorter_names(text.host(F.col("url")), ["."]), "|").alias("names"))
