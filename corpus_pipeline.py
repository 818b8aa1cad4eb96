"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing. Each stage reads what its predecessor wrote.

Defined results: a null text counts as empty and is rejected by the quality rules; repeated rows are near-duplicates of
each other, and one stays; rows with null or repeated ids are kept apart by their texts; an empty table gives no rows;
very long texts go through whole; extra columns stay as they are up to packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import packing, quality, simhash, toxicity
from cairn.llm.common import discard, small_batches, stored, table

#: Entries of a worker's tables of words in packing: its workers stay alive while other stages run.
KEPT_WORDS = 1 << 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.kept(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model is fitted on the labelled documents of sf_dir."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of linked fingerprints."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 4,096 tokens."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, kept=KEPT_WORDS)


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("simhash", near_dedup), ("packing", pack)]

#: Fingerprint bits, FTRL weights and tokenizer ids are not SQL's; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        then = stored(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = then
    return docs
