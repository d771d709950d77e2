"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm import packing, pii, quality, simhash
from framefold.llm.common import removed, shared_folder, staged, temporary
from framefold.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    with staged(spark, docs):
        return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles the one with the smallest doc_id stays."""
    with staged(spark, docs):
        return simhash.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms.  n_chars follows the text, whose addresses may change their length."""
    with staged(spark, docs):
        changed = pii.pseudonymised(docs, pii.secret_key(docs), counts=False)
        return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; an empty table gives an empty result."""
    with staged(spark, docs):
        return packing.packed(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("pseudonyms", pii_stage),
    ("packing", packing_stage),
]

#: Packing and the fingerprints can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's own intermediates, and its input, go once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/framefold-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with temporary(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return docs
