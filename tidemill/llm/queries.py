"""The thin queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .decontamination import find_contamination
from .jaccard import similar_groups
from .mixing import mix, word_count
from .neighbours import nearest
from .secrets import scan_secrets
from .sharding import feistel_shards
from .substrings import remove_repeats
from .token_output import ids_table
from .toxicity import fold, score_toxicity
from .warc import read_warc, write_warc


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return feistel_shards(spark, rows, ["doc_id", "text_crc32", "size"], 24, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n_removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(spark, docs).select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op4_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(F.col("base_text"), 256).alias("base_sha256"), F.col("spans_text").alias("spans"),
    )


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(spark, docs, "doc_id", "source", "size", [5, 2, 1]).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_warc(spark, _table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_path(spark, "warc"), least=0)
    return read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_table(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(spark, docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op10_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(spark, docs, _table(spark, sf_dir, "labels")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_sharding": op1_feistel_sharding,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_kmeans_tree_neighbours": op3_kmeans_tree_neighbours,
    "op4_linked_secrets": op4_linked_secrets,
    "op5_weighted_mix": op5_weighted_mix,
    "op6_warc_archives": op6_warc_archives,
    "op7_partition_jaccard": op7_partition_jaccard,
    "op8_rans_token_ids": op8_rans_token_ids,
    "op9_benchmark_windows": op9_benchmark_windows,
    "op10_nnpu_toxicity": op10_nnpu_toxicity,
}
