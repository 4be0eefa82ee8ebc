"""Catalogue queries over every row of their tables: nothing is cut before the operator sees it."""

import hashlib


def closed(edges):
    """{item: smallest item that links reach}, by brute force."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for item, group in edges:
        a, b = find((0, item)), find((1, group))
        root[max(a, b)] = min(a, b)
    return {x[1]: find(x)[1] for x in list(root) if x[0] == 0}


def test_closure_follows_every_link(spark, tmp_path):
    from tidemill.plans.catalog import QUERIES

    # small quantities and no discounts among them; suppliers 1-4 are one chain, 5 and 6 another, 7 is alone
    edges = [(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 12), (6, 13), (5, 13), (7, 14)]
    rows = [(s, o, float(1 + 49 * (i % 2)), 0.1 * (i % 3 == 0)) for i, (s, o) in enumerate(edges)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"s{i}", i % 2) for i in range(1, 8)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = closed(edges)
    assert want == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert {r["l_suppkey"]: r["component"] for r in QUERIES["closure_components"](spark, str(tmp_path)).collect()} == want
    lines = {c: "\n".join(f"{i}|s{i}|{i % 2}" for i in sorted(want) if want[i] == c) for c in set(want.values())}
    got = {r["component"]: r["fingerprint"] for r in QUERIES["closure_fingerprint"](spark, str(tmp_path)).collect()}
    assert got == {c: hashlib.sha256(x.encode()).hexdigest() for c, x in lines.items()}


def test_source_cap_discards_no_document(spark, tmp_path):
    from tidemill.plans.catalog import QUERIES

    rows = [(i, f"src{i % 3 if i % 7 else 9}" if i % 11 else None, 1 + i * 37 % 90) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    promoted, deferred, counts = [], [], {}
    for r in ordered[:80]:
        counts[r[1]] = counts.get(r[1], 0) + 1
        (promoted if counts[r[1]] <= 2 else deferred).append(r)
    want = {r[0]: i for i, r in enumerate(promoted + deferred + ordered[80:], 1)}
    assert {r["doc_id"]: r["new_place"] for r in QUERIES["source_cap_defer"](spark, str(tmp_path)).collect()} == want


def test_notes_of_every_line_are_inverted(spark, tmp_path):
    from tidemill.plans.catalog import QUERIES

    rows = [(i % 5, (i * 7) % 23, float(1 + i % 50)) for i in range(120)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {p: ",".join(map(str, sorted({o for q, o, _ in rows if q == p}))) for p in range(5)}
    assert {r["id"]: r["notes"] for r in QUERIES["inverted_notes"](spark, str(tmp_path)).collect()} == want
