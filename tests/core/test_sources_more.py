"""XML, page text, shards by manifest, writing what changed."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_xml_and_text(spark):
    from tidemill.sources.markup import main_text, xml_records

    xml = "<r xmlns='urn:x'><law><name>A</name><no> 1 </no></law><law><name>B</name></law></r>"
    df = spark.createDataFrame([(1, xml), (2, "<bad"), (3, None)], "n int, body string")
    assert [tuple(r) for r in xml_records(df, "body", "law", {"title": "name", "number": "no"}, ["n"]).orderBy("n", "place").collect()] == [(1, 0, "A", "1"), (1, 1, "B", None)]
    page = "<nav><a href='/'>home</a></nav><p>" + "long text " * 30 + "</p><p>" + "long text " * 30 + "</p><ul><li><a>only link</a></li></ul><script>x</script>"
    assert main_text(page).count("long text") == 30 and "only link" not in main_text(page) and main_text("<p>short</p>") is None and main_text(None) is None


def test_shards_and_changes(spark, tmp_path):
    from tidemill.sources.tables import read_shards, write_if_changed, write_shards

    df = spark.createDataFrame([("2024", 1), ("2024", 2), ("2023", 3)], "y string, n long")
    write_shards(df, f"{tmp_path}/s", F.col("y"))
    schema = T.StructType([T.StructField("n", T.LongType())])
    assert sorted(r["n"] for r in read_shards(spark, f"{tmp_path}/s", schema, ["2024"], {"2024": 2, "2023": 1}).collect()) == [1, 2]
    with pytest.raises(ValueError):
        read_shards(spark, f"{tmp_path}/s", schema, ["2023"], {"2023": 5})
    assert write_if_changed(df, f"{tmp_path}/t") and not write_if_changed(df.orderBy("n"), f"{tmp_path}/t") and write_if_changed(df.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_locales(spark):
    from tidemill.functions.text import localised

    df = spark.createDataFrame([({"zh": ("t", " ")}, "en"), (None, "en")], "m map<string, struct<title: string, body: string>>, e string")
    assert [tuple(r) for r in df.select(localised(F.col("m"), "zh", "title", F.col("e")), localised(F.col("m"), "zh", "body", F.col("e"))).collect()] == [("t", "en"), ("en", "en")]
