"""A training-data pipeline over `documents`, stage after stage.

Each stage is a function of (spark, docs, sf_dir): docs is what the stage before kept, with the
columns of `documents`; tables beside it are read from sf_dir. Each result is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticketscope.llm import decontaminate, mixing, quality_model, simhash, token_store
from ticketscope.llm.common import read_table
from ticketscope.llm.queries import END_ID, QUALITY_LEAST, TOKENIZER, fold
from ticketscope.session import ensure_checkpoint_dir, scratch_dir, scratch_scope
from ticketscope.sources import files


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of this stage's documents."""
    ensure_checkpoint_dir(spark)
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"), "quality", fold(4) != 2)
    return quality_model.keep_good(docs, model, QUALITY_LEAST)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ensure_checkpoint_dir(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training set in training order: a row for each copy that the mix takes."""
    ensure_checkpoint_dir(spark)
    return mixing.training_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written and read back: doc_id, start, n_tokens and ids_crc32 of each row."""
    ensure_checkpoint_dir(spark)
    return token_store.token_table(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_output),
]

#: The classifier, SimHash and the tokenizer can't be said in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_dir(spark, "pipeline-" + name.split()[0].lower())
        with scratch_scope(spark):  # the stage's own tables go once its result is written
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before:
            files.delete(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return docs
