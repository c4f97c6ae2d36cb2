"""Documents to token ids: quality, near-duplicates, benchmark leaks, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, hyperminhash, pii_bootstrap, quality_mil
from palimpsest.llm.session import remove, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance classifier accepts."""
    return quality_mil.keep(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return hyperminhash.keep_one(docs, k=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of two benchmark items or more; one item's are cut out of the text, which n_chars follows."""
    return decontaminate.scrub(docs, _table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("bigint"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found spans replaced by their kinds; n_chars follows the text."""
    return pii_bootstrap.mask(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very bytes."""
    own = bpe.tokenize(docs.withColumn("__bytes", F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return own.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", (F.col("decoded") == F.col("__bytes")).alias("round_trip"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", benchmark_leaks), ("PII", personal_data), ("byte-level BPE", tokens)]

#: The classifier's fit and the tokenizer can't be said in SQL; the tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again.

    A stage's result is removed once the next one's is whole; the last one's stays, as what is returned reads it.
    """
    docs, folder = _table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
