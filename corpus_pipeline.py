"""A training-data pipeline of stages, each one operator of ``strandweave.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import decontaminate, language_id, mixing, ngram_join, training_order
from strandweave.llm.common import load
from strandweave.llm.queries import MIX_TARGETS, tokenizer_path
from strandweave.session import write_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, by a model of the documents' own labels."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingle similarity."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by rates that meet the target shares of the labelled domains."""
    return mixing.mixed(docs, mixing.label_domains(load(spark, sf_dir, "labels")), MIX_TARGETS, relative=True)


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token shards in training order; returns their index."""
    index, _, _ = training_order.materialise(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
    return index


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mix_sources),
    ("training_order", training_shards),
]

#: Trained models and a keyed permutation are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_stage(docs, name)
    return docs
