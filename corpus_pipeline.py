"""Corpus pipeline: documents in, token ids out.

Each stage calls one operator of ``tessera.llm``, works on all rows that the
stage before it kept, and is written as Parquet and read again.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_fst, decontam, langid, secret_scan, simhash
from tessera.llm.base import documents, table
from tessera.llm.queries import MULTI_RANKS
from tessera.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts with a letter that the
    network does not take for random characters.  Null and empty texts go;
    repeated rows stay or go alike; an empty table stays empty."""
    return langid.keep_identified(docs, langid.fit(docs, background=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a reported secret."""
    return secret_scan.keep_without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests."""
    return bpe_fst.encode_documents(docs, bpe_fst.read_ranks(public_tokenizers.path(MULTI_RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", drop_secrets),
    ("byte_bpe", encode),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
