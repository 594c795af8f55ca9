"""The queries of this package, as (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ampflow.llm import (
    bpe, codes, mixing, ngram_join, pii, quality_classifier, quality_rules, repeats, resample, secrets, simhash, sketch, toxicity,
)
from ampflow.llm.common import benchmark, documents, embeddings, labelled


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": lambda spark, d: secrets.report(documents(spark, d)),
        "op2_source_mix": lambda spark, d: mixing.report(documents(spark, d)),
        "op3_bpe": lambda spark, d: bpe.encoded(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json")),
        "op4_quality_rules": lambda spark, d: quality_rules.report(documents(spark, d)),
        "op5_quality_classifier": lambda spark, d: quality_classifier.report(documents(spark, d), labelled(spark, d)),
        "op6_simhash": lambda spark, d: simhash.report(documents(spark, d)),
        "op7_fingerprints": lambda spark, d: sketch.report(documents(spark, d)),
        "op8_toxicity": lambda spark, d: toxicity.report(documents(spark, d), labelled(spark, d)),
        "op9_repeats": lambda spark, d: repeats.report(documents(spark, d)),
        "op10_pii": lambda spark, d: pii.report(documents(spark, d)),
        "op11_vector_codes": lambda spark, d: codes.report(embeddings(spark, d)),
        "op12_ngram_join": lambda spark, d: ngram_join.report(documents(spark, d)),
        "op13_target_resampling": lambda spark, d: resample.report(documents(spark, d), benchmark(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.SQL,
        "op9_repeats": repeats.SQL,
        "op11_vector_codes": codes.SQL,
        "op12_ngram_join": ngram_join.SQL,
        "op13_target_resampling": resample.SQL,
    }
