"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; a stage's result is written and read again before the next one begins.  All
but the last return the columns of ``documents``.

SQL cannot express the classifier, so there is no ORACLE_SQL;
``tests/llm/test_pipeline.py`` holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseward.llm import bpe, lines, mixing, quality, similar
from caseward.llm.slabs import bounded_batches
from caseward.sources.shared import stored

ORACLE_SQL = None
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    bounded_batches(spark)
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; what has nothing left goes."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more."""
    bounded_batches(spark)
    return similar.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where a quota ends."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text decoded from them."""
    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), decode=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
