"""Rules of nested documents on case files written for these tests."""

import json

from pyspark.sql import functions as F

GOOD = {
    "schema_version": 1, "dossier_id": "food-labels", "kind": "new", "seed_item_id": "raw-" + "0" * 16, "next_action": "read", "hold": {"state": "RETRY_WAIT", "reason": "later", "unblock_condition": "date", "retry_after": "2024-03-01"},
    "sources": [
        {"id": "s1", "url": "https://laws.e-gov.go.jp/law/1", "kind": "egov_law", "status": "fetched", "attempts": 1, "sha256": "a" * 64, "fetched_at": "2024-02-01T00:00:00+09:00", "version": {"as_of": "2024-02-01"}},
        {"id": "s2", "url": "https://www.jsda.or.jp/x", "kind": "self_regulatory", "status": "failed", "error_class": "http_5xx", "last_attempt_at": "2024-02-01T00:00:00Z"},
    ],
    "facts": [
        {"id": "f1", "category": "instrument_form", "status": "confirmed", "statement": "a bill", "source_ids": ["s1"], "value": "bill"},
        {"id": "f2", "category": "business_impact", "status": "inference", "statement": "some"},
        {"id": "f3", "category": "obligation_type", "status": "confirmed", "statement": "must", "source_ids": ["s1"], "values": ["obligation", "none"]},
    ],
    "unresolved": ["scope"],
}


def found(spark, *docs):
    from tidemill.operators.validation import CASE_FILE, case_file_problems

    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.from_json("j", CASE_FILE).alias("d"))
    return [list(r[0]) for r in df.select(case_file_problems(F.col("d"), F.lit("food-labels"))).collect()]


def test_a_good_file_and_an_empty_one(spark):
    assert found(spark, GOOD, {}) == [[], ["schema_version", "dossier_id", "kind"]]


def test_each_rule(spark):
    bad = json.loads(json.dumps(GOOD))
    bad |= {"schema_version": 2, "dossier_id": "other", "kind": "old", "seed_item_id": "raw-1", "stage": "x", "next_action": " ", "unresolved": ["a", " "]}
    bad["hold"] = {"state": "RETRY_WAIT", "reason": "", "unblock_condition": "never"}
    bad["sources"] = [
        {"id": "s1", "url": "http://laws.go.jp/", "kind": "blog", "status": "fetched", "attempts": -1, "sha256": "x", "fetched_at": "2024-02-01", "error_class": "http_4xx", "excerpt": "e" * 1501, "version": {"as_of": "2024-2-1"}},
        {"id": "s1", "url": "https://evil.example/go.jp", "kind": "diet", "status": "failed", "error_class": "odd"}, None, {"id": "s9", "url": "https://www.meti.go.jp/", "kind": "ministry", "status": "not_fetched"},
    ]
    bad["facts"] = [
        {"id": "f1", "category": "scope", "status": "confirmed", "statement": "s", "source_ids": ["s8", "s9"]}, {"id": "f1", "category": "scope", "status": "inference", "statement": "", "quote": "q" * 601},
        {"id": "x", "category": "weather", "status": "sure", "statement": "s"}, {"id": "f4", "category": "instrument_form", "status": "confirmed", "statement": "s", "value": "poem"},
        {"id": "f5", "category": "obligation_type", "status": "confirmed", "statement": "s", "source_ids": ["s1"], "values": ["maybe"]},
    ]
    got = found(spark, bad)[0]
    assert sorted(got) == sorted([
        "schema_version", "dossier_id", "kind", "seed_item_id", "stage", "next_action", "unresolved", "hold.reason", "hold.unblock_condition", "hold.retry_after missing",
        "sources[0].id", "sources[0].url", "sources[0].kind", "sources[0].attempts", "sources[0].sha256", "sources[0].fetched_at", "sources[0].error_class", "sources[0].excerpt", "sources[0].version.as_of",
        "sources[1].id", "sources[1].url", "sources[1].error_class", "sources[1].last_attempt_at", "sources[2]",
        "facts[0].id", "facts[0].source_ids unknown", "facts[0].source_ids not fetched", "facts[1].id", "facts[1].statement", "facts[1].quote", "facts[1].inference",
        "facts[2].id", "facts[2].category", "facts[2].status", "facts[3].source_ids missing", "facts[3].value", "facts[4].source_ids not fetched", "facts[4].values",
    ])
