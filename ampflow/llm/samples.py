"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: int
) -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``each`` labelled texts of either class, and the classes' sizes among all rows to learn from.

    The rows of a class are those with the lowest hashes of their ids; so the sample is the same in
    every run. Rows without an id or label are left out. At most 2 * each ids are broadcast.
    """
    usable = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    sizes = {int(r[0]): int(r[1]) for r in usable.groupBy(label).count().collect()}
    parts = [
        usable.where(F.col(label) == k).select("doc_id", F.col(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        for k in (0, 1)
    ]
    chosen = parts[0].union(parts[1])
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = met.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return rows.toPandas().sort_values(["doc_id", "label", "text"], ignore_index=True), sizes
