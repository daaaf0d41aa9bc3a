"""The ``opN_<name>`` queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, decontaminate, media, minhash, packing, passages, phrases, prefix_trie, quality, sharding, token_files, warc
from millrace.llm.oracle import ORACLE_SQL  # noqa: F401
from millrace.llm.runtime import prepare, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), into="found")
    fields = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_at"]
    return found.select("doc_id", *[f"found.{f}" for f in fields])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), root, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, root)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every cluster; documents without a repeated paragraph have no row."""
    found = passages.clusters(table(spark, sf_dir, "documents"))
    name = lambda c: F.when(F.col(c) != passages.LAST, F.col(c))
    return found.select(
        name("doc").alias("doc_id"), "first_word", "n_words", F.col("cluster").alias("cluster_id"), name("keeper").alias("kept_doc_id"), F.col("keeper_word").alias("kept_first_word"), "copies", "removed"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    names = warc.write_archives(table(spark, sf_dir, "pages"), root)
    found = warc.read_archives(spark, root, names, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_files, op3_sharding, op4_packing, op5_passages, op6_warc, op7_quality, op8_minhash, op9_perspectives, op10_media, op11_phrases, op12_prefix_trie, op13_bpe)
}
