"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm import (decontaminate, hard_negatives, lexical_search, line_dedup, mixing, quality_model, quality_rules,
                             simhash, token_store, toxicity, url_filter, warc, winnowing)
from ticketscope.llm.common import read_table
from ticketscope.llm.oracles import ORACLES  # noqa: F401  for the driver
from ticketscope.session import ensure_checkpoint_dir, scratch_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
QUALITY_LEAST = 0.7
TOXIC_LEAST = 0.5


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", F.concat_ws(",", "broken").alias("broken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return mixing.mixed(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic", fold(5) != 0)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_LEAST).cast("int").alias("predicted"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return token_store.token_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, "warc")
    warc.write_pages(read_table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
                        "longest_words", "longest_at", "longest_item")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"), "quality", fold(4) != 2)
    return quality_model.score(docs, model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return winnowing.compared(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_prints")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_simhash, op4_url_filter, op5_toxicity,
                                   op6_token_store, op7_line_dedup, op8_warc, op9_decontaminate, op10_quality_model, op11_hard_negatives,
                                   op12_lexical_search, op13_winnowing)}
