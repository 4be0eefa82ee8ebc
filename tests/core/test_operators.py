"""Operators on hand-made rows, and each catalogue query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _names():
    from tidemill import plans

    return list(plans.catalog.QUERIES)


def _plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", _names())
def test_query_says_what_its_sql_says(spark, duck, name):
    from tidemill.plans.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)


def test_appending_twice_adds_nothing(spark):
    from tidemill.operators.identity import append_unseen

    old = spark.createDataFrame([("a", "u1", 0)], "id string, url string, ord int")
    new = spark.createDataFrame([("a", "u9", 0), ("b", "u1", 1), ("c", "u2", 2), ("c", "u3", 3)], "id string, url string, ord int")
    first = append_unseen(old, new, "id", "url", F.lit(True), "ord")
    assert [r["id"] for r in first.collect()] == ["c"]
    assert append_unseen(old.union(first), new, "id", "url", F.lit(True), "ord").count() == 0
    assert sorted(r["id"] for r in append_unseen(old, new, "id", "url", F.lit(False), "ord").collect()) == ["b", "c"]


def test_deadline_outcomes(spark):
    from tidemill.operators.deadlines import propagate

    t = spark.createDataFrame([(i, k, "2024-01-10") for i, k in enumerate("abcdef")], "id int, k string, d string").withColumn("day", F.col("d").cast("date"))
    s = [(10, "a", "2024-01-11", "2024-02-01"), (11, "b", "2024-01-10", "x"), (12, "b", "2024-01-10", "2024-02-01"), (13, "c", "2024-01-10", "2024-02-01"), (14, "c", "2024-01-10", "2024-02-02"),
         (15, "d", "2024-01-10", "2024-02-01"), (16, "d", "2024-01-10", "2024-02-01"), (17, "e", "2024-01-12", "2024-02-01")]
    s = spark.createDataFrame(s, "id int, k string, d string, deadline string").withColumn("day", F.col("d").cast("date"))
    got = {r["id"]: (r["outcome"], r["source_id"]) for r in propagate(t, s, "k", "day", F.lit(True)).collect()}
    assert got == {0: ("matched", 10), 1: ("invalid", None), 2: ("conflicting", None), 3: ("ambiguous", None), 4: ("none", None), 5: ("none", None)}


def test_streaks_after_runs(spark):
    from tidemill.operators.health import gate, next_state, totals

    report = spark.createDataFrame([("a", "success", 0), ("b", "error", 0), ("c", "success", 5), ("d", "success", 1)], "source_key string, status string, fetched_count int")
    previous = spark.createDataFrame([("a", 2, 0, "t0", None), ("b", 1, 0, "t0", None), ("c", 0, 3, "t0", None)], "source_key string, consecutive_zero_runs int, consecutive_error_runs int, last_problem_at string, last_recovered_at string")
    state = next_state(report, previous, "t1")
    got = {r["source_key"]: tuple(r)[1:] for r in state.collect()}
    assert got == {"a": (3, 0, "zero", "t1", None), "b": (0, 1, "error", "t1", None), "c": (0, 0, "healthy", "t0", "t1"), "d": (0, 0, "healthy", None, None)}
    assert [tuple(r) for r in gate(state, spark.createDataFrame([("a", True), ("b", False)], "source_key string, required boolean")).collect()] == [("a", 3, "failure")]
    assert tuple(totals(state).first()) == (2, 1, 1, False)


def test_components_chain(spark):
    from tidemill.operators.linking import components

    edges = spark.createDataFrame([(i, f"g{i}") for i in range(20)] + [(i + 1, f"g{i}") for i in range(20)] + [(50, "x"), (51, "x"), (60, None)], "item int, g string")
    got = {r["item"]: r["component"] for r in components(spark, edges, "item", "g").collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}


def test_markup(spark):
    from tidemill.sources.markup import entries, is_maintenance

    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024</pubDate></item><item><description>no title</description></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://y"/><updated>2024-01-02</updated></entry></feed>'
    page = "<h2>2024年1月5日</h2><a href='/1'>One <b>x</b></a><p>2024/2/6</p><a href='/2'>Two</a><script>2030-01-01 <a href='/3'>no</a></script>"
    rows = "<table><caption>Cat</caption><tr><td>2024-01-01</td><td>Title</td><td><a href='/t'>go</a></td></tr></table>"
    df = spark.createDataFrame([(0, rss, "feed"), (1, atom, "feed"), (2, page, "links"), (3, rows, "rows"), (4, "not xml", "feed"), (5, None, "links")], "n int, body string, kind string")
    got = [(r["n"], r["title"], r["link"], r["published"]) for r in entries(df, "body", F.col("kind"), ["n"]).orderBy("n", "place").collect()]
    assert got == [(0, "A & B", "http://x/1", "Mon, 01 Jan 2024"), (1, "T", "http://y", "2024-01-02"), (2, "One x", "/1", "2024-01-05"), (2, "Two", "/2", "2024-02-06"), (3, "Title", "/t", "2024-01-01")]
    assert [r[0] for r in spark.createDataFrame([("<title>Under Maintenance</title>",), ("<p>Maintenance</p>",)], "h string").select(is_maintenance(F.col("h"), ["Maintenance"])).collect()] == [True, False]


def test_json_files(spark, tmp_path):
    from pyspark.sql import types as T

    from tidemill.sources.tables import json_array, json_folder, json_or_empty, write_csv, write_shards

    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1}, 5, {"id": "y"}]')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in json_array(spark, str(tmp_path / "a.json"), schema).collect()] == [(0, "x", 1), (2, "y", None)]
    with pytest.raises(Exception):
        json_array(spark, str(tmp_path / "a.json"), schema, strict=True).collect()
    assert json_or_empty(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text('{"id": "q", "n": 2}')
    (tmp_path / "docs" / "two.json").write_text("{broken")
    got = {r["stem"]: (r["id"], r["error"] is not None) for r in json_folder(spark, str(tmp_path / "docs"), schema).collect()}
    assert got == {"one": ("q", False), "two": (None, True)}
    df = spark.createDataFrame([("2024", 1, "=x"), ("2023", 2, "y")], "y string, n int, t string")
    write_shards(df, str(tmp_path / "out"), F.col("y"))
    assert sorted(p.name for p in (tmp_path / "out").glob("period=*")) == ["period=2023", "period=2024"]
    write_csv(df.select("n", "t"), str(tmp_path / "csv"))
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode().split("\r\n")
    assert "﻿" + '"n","t"' in lines and '"1","\'=x"' in lines


def test_documents(spark):
    import json

    from tidemill.operators import documents as D

    tree = json.dumps({"tag": "Law", "children": [{"tag": "Article", "attr": {"Num": "1"}, "children": ["a  b", {"tag": "P", "children": ["c"]}, "d"]}]})
    rows = spark.createDataFrame([(tree,), ("{bad",), (None,)], "t string")
    assert sorted(tuple(r) for r in D.provisions(rows.select(F.lit(1).alias("k"), "t"), "t", ["k"]).collect()) == [(1, "/Law/Article[1]", "a b d"), (1, "/Law/Article[1]/P", "c")]
    one = spark.range(1)
    assert one.select(D.budgeted(F.array(F.lit("abc"), F.lit("defg"), F.lit("h")), 5)).first()[0] == ["abc", "de"]
    assert one.select(D.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))).first()[0] == {"a": 1, "b": 3}
    assert one.select(D.unpacked_id(D.packed_id(F.lit("zh"), F.lit("raw-12"), F.lit("f" * 64), F.lit(5)))).first()[0].asDict() == {"kind": "zh", "id": "raw-12", "digest": "f" * 16, "mask": 5}
    assert one.select(D.first_object(F.lit('text {"a": 1} tail'))).first()[0] == '{"a": 1}'


def test_entry_works_without_the_training_data_package():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "tidemill"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
