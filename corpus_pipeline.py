"""A training-data pipeline over ``documents``: toxicity, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import decontam, mixing, simhash, tokens, toxicity
from lodestack.llm.common import remove, scratch, table
from lodestack.llm.queries import tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the calibrated threshold of their language go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays. Candidates have near fingerprints, links 80 % of their five-word shingles."""
    return simhash.keep_first(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them each document's place, length and checksum."""
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("benchmark_decontamination", contaminated_out),
    ("source_mixing", mixed),
    ("token_output", tokenized),
]

#: The trained classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if k:
            remove(spark, f"{base}/{STAGES[k - 1][0]}")
    return docs
