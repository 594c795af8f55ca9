"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ampflow.llm import bpe, mixing, quality_rules, secrets, simhash
from ampflow.llm.common import shared_folder

#: The tokenizer's file; a parameter of the last stage.
TOKENIZER = "byte_bpe_50k.json"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near-duplicates; of equal rows one."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced by a mark; n_chars follows. A null text stays null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it; documents without words are taken 0 times or more."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix, with their counts and digests."""
    return bpe.encoded(docs, public_tokenizers.path(TOKENIZER), with_ids=True).drop("decoded")


STAGES = [
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode_texts),
]

#: SimHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}_{name}")
        docs = spark.read.parquet(f"{place}/{k}_{name}")
    return docs
