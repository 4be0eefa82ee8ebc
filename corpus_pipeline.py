"""A corpus from raw documents to token ids: each stage applies one operator to what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, joined, written
from tidemill.llm.decontamination import decontaminated
from tidemill.llm.jaccard import set_groups
from tidemill.llm.mixing import mix, word_count
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.token_output import ids_table
from tidemill.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic.  Rows with null or empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(spark, docs.select(*COLUMNS), labels).where(F.col("tox_predicted") == 0).select(*COLUMNS)


def row_mark(docs: DataFrame) -> Column:
    """128 bits that tell rows of different values apart; equal rows have the same."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in docs.columns]
    return F.unhex(F.md5(F.concat(*parts)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, null last; of those, with the smallest text.

    Rows with empty texts are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("row", row_mark(docs))
    groups = set_groups(spark, docs, "doc_id", "text", "row").where("grp IS NOT NULL")
    least = cut(spark, groups.groupBy(F.col("grp").alias("g")).agg(F.min("key").alias("low"), F.count("*").alias("members")))
    first = joined(groups, least, ("grp", "g"), "members").where(F.col("key").eqNullSafe(F.col("low")))
    # equal rows are in one group, so a mark has one
    first = cut(spark, first.groupBy("grp", F.col("row").alias("k")).agg(F.count("*").alias("rows")))
    sizes = first.groupBy(F.col("grp").alias("g")).agg(F.sum("rows").alias("rows"), F.min("k").alias("k"))
    keep = cut(spark, sizes)
    empty = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = docs.join(keep.where("rows = 1"), F.col("row") == F.col("k"), "left_semi").union(empty).select(*COLUMNS)
    if not keep.where("rows > 1").limit(1).count():
        return out
    several = first.select("grp", "k").join(keep.where("rows > 1").select("g"), F.col("grp") == F.col("g"), "left_semi")
    several = docs.join(several, F.col("row") == F.col("k")).groupBy("grp").agg(F.min(F.struct("text", "doc_id", "lang", "source", "n_chars")).alias("r"))
    return out.union(several.select("r.*").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; the others go as a whole."""
    return decontaminated(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it does; a last part of a text ends after the words taken.

    Rows without words are taken by no budget and go.
    """
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("row", row_mark(docs))
    # a row without a doc_id has a place of its own in the order, and rows of one doc_id have each its own take
    place = F.coalesce(F.col("doc_id").cast("string"), F.hex("row"))
    sizes = docs.select("row", place.alias("place"), "source", word_count(F.col("text")).alias("size"))
    taken = mix(spark, sizes, "place", "source", "size", [5, 2, 1], tie="row").select(F.col("row").alias("k"), "size", F.col("mix_taken").alias("taken")).where("size > 0")
    # equal rows are neighbours in the order: together they give whole texts and one part at most
    taken = cut(spark, taken.groupBy("k", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows")))
    met = F.col("row") == F.col("k")
    if taken.where("rows > 1").limit(1).count():
        several = docs.join(taken.where("rows > 1").select("k"), met, "left_semi").dropDuplicates(["row"])
        docs = docs.join(taken.where("rows = 1").select("k"), met, "left_semi").union(several)
    rows = docs.join(taken.where("taken > 0"), met)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    times = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("words", F.explode(times))
    head = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.concat(head, F.array_join(F.slice(pieces, F.lit(1), F.col("words")), ""))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts, written as shards and read back: doc_id, start, n_tokens, ids_crc32."""
    return ids_table(spark, docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
