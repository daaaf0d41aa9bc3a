"""From raw documents to packed sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again before the next one. All but the last return the columns
of their input. ``ORACLE_SQL`` is None: quality votes and byte-pair ids are not
SQL; each stage is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, minhash, packing, passages, quality
from millrace.llm.queries import vocabulary
from millrace.llm.runtime import prepare, scratch

ORACLE_SQL = None
SCORE = "_millrace_score"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for label 1 stay (a score of a half or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, into=SCORE).where(F.col(SCORE) >= 0.5).drop(SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows equal in id and text are a group too."""
    found = minhash.near_duplicates(docs).select(F.col("doc_id").alias("_millrace_id"), F.col("text_hash").alias("_millrace_hash"), "n_shingles", "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_millrace_id")) & (F.xxhash64("text") == F.col("_millrace_hash"))
    gone = found.where("not kept").select("_millrace_id", "_millrace_hash").distinct()
    left = docs.join(gone, same, "left_anti")
    again = found.where("kept and n_shingles > 0").groupBy("_millrace_id", "_millrace_hash").count().where("count > 1").select("_millrace_id", "_millrace_hash")
    if again.isEmpty():
        return left
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs are cut out of all documents but their first; ``n_chars`` follows."""
    cut = passages.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a 20th or more go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
