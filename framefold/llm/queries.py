"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framefold.llm import bpe, chat, ego, html, oracles, packing, pii, quality, shards, simhash, warc
from framefold.llm.common import only, written
from framefold.sources.tables import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(only(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pii.pseudonymised(docs, pii.secret_key(docs))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    rows = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(written(chat.linear(rows), "turns")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_grid_order": op1_grid_order,
    "op2_bpe_tree": op2_bpe_tree,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_bin_completion": op4_bin_completion,
    "op5_simhash": op5_simhash,
    "op6_main_text": op6_main_text,
    "op7_warc": op7_warc,
    "op8_reply_trees": op8_reply_trees,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op1_grid_order": oracles.GRID_ORDER,
    "op7_warc": oracles.WARC,
    "op8_reply_trees": oracles.CHAT,
    "op10_quality_rules": oracles.quality(),
}
