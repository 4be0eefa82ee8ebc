"""Tables in a folder, and JSON with a stated schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A JSON array of objects with its places in ``ord``.

    Elements that are no objects are dropped, or with ``strict`` fail the read; so does a file that isn't an array.
    """
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "value"))
    wrong = ~F.trim("value").startswith("{")
    if strict:
        parts = parts.withColumn("value", F.when(wrong, F.raise_error(F.lit("an element is not an object"))).otherwise(F.col("value")))
    else:
        parts = parts.where(~wrong)
    fields = T.StructType([f for f in schema.fields if f.name != "ord"])
    return parts.select(F.col("ord").cast("long").alias("ord"), F.from_json("value", fields).alias("r")).select("ord", "r.*")


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like :func:`json_array`, but a missing path gives no rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], schema)
    return json_array(spark, path, schema)


def json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A document in each file: ``stem``, its fields, and ``error`` where it can't be read."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    row = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    return text.select("stem", row.alias("r")).select("stem", *[F.col("r").getField(f.name).alias(f.name) for f in schema.fields], F.col("r._bad").alias("error"))


def write_shards(df: DataFrame, path: str, period: Column) -> None:
    """One folder a period, one JSON object a line; periods that are no longer there go, others are replaced as a whole."""
    df.withColumn("period", period).repartition("period").write.mode("overwrite").partitionBy("period").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells as :func:`tidemill.functions.text.csv_cell` makes them, CRLF ends, a byte-order mark first in each file's header line."""
    from ..functions.text import csv_cell

    line = F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in df.columns])
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    rows = df.select(line.alias("value"))
    first = df.sparkSession.createDataFrame([("﻿" + head,)], "value string")
    first.coalesce(1).unionAll(rows).write.option("lineSep", "\r\n").mode("overwrite").text(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, periods: list[str], expected: dict[str, int]) -> DataFrame:
    """Rows of the periods asked for; only their folders are read, and a shard whose count isn't the manifest's is an error."""
    rows = spark.read.schema(schema).option("basePath", path).json([f"{path}/period={p}" for p in periods])
    found = {str(r["period"]): r["count"] for r in rows.groupBy("period").count().collect()}
    wrong = {p: (found.get(p, 0), expected.get(p)) for p in periods if found.get(p, 0) != expected.get(p)}
    if wrong:
        raise ValueError(f"shards differ from their manifest: {wrong}")
    return rows


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a table unless the one that is there has the same rows; says whether it was written.

    The new table is whole before the old one is moved aside, and the old one goes last: a run that is stopped in
    between loses neither, and the next call puts the old table back where the path is empty.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, fresh, aside = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    if fs.exists(aside) and not fs.exists(at):
        fs.rename(aside, at)
    if fs.exists(at):
        old = spark.read.schema(df.schema).parquet(path)
        same = lambda a: a.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        if same(old) == same(df):
            return False
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(aside, True)
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(fresh, at):
        raise OSError(f"{path} can't be written")
    fs.delete(aside, True)
    return True
