"""Corpus pipeline: language ID, exact dedup, near dedup, source mixing, tokenisation.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tarmac.llm.common import Scratch, release_heaps, table
from tarmac.llm.queries import public_vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any language (null, or without a letter) go; the model learns from three quarters of the labelled rows."""
    return language_id.keep_identified(docs, language_id.fit(docs, ~language_id.held_out()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their weights."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256: every text's tokens, and the digest of what they decode to."""
    encoded = bpe.encode(docs, *public_vocabulary(), decode_too=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _released(stage):
    """The stage, begun after the executors gave back what the stage before it left in their heaps."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _released(identify_language)),
    ("exact_dedup", _released(drop_exact_copies)),
    ("near_dedup", _released(drop_near_copies)),
    ("source_mixing", _released(mix_sources)),
    ("byte_bpe", _released(encode)),
]

#: SQL cannot express the language model or BPE; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
    return docs
