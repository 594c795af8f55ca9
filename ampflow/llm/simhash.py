"""SimHash near-duplicate classes with pigeonring filtering.

A fingerprint has four 16-bit segments on a ring. If two fingerprints differ in at most 3 bits
then, by the pigeonring principle, from some segment i every chain of l consecutive segments
holds at most l * 3 / 4 differences: none in segment i, at most one in two segments, at most two
in three. Two consequences are exact: either segment i+2 differs in at most one bit, and a
half of segment i+1 and a half of segment i+2 are equal; or it differs in two, and segment
i+1 is equal. So each distinct fingerprint takes part in 20 buckets whose keys hold 32 equal bits,
and inside a bucket the chain budgets prune pairs before the full Hamming distance.

Copies of a text meet in one fingerprint before anything is joined. A bucket gives a
spanning forest, never its pairs. A bucket of more than ``BUCKET`` distinct fingerprints is
not compared as it is: its members go through 560 keys that hold 52 equal bits each (three
of sixteen nibbles left out), where a bucket has at most 4,096 members by construction.

Defined results: a null or blank text has fingerprint zero and links as any other; a null
doc_id is linked by its text and is never the smallest; a class without any id has a null
component_id; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.llm.common import durable, row_hash, shielded
from ampflow.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
BUCKET = 2048
MASK = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        of = xxhash.xxh64_intdigest
        hashes = [of(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, dtype="<u8")
    for at in range(0, len(every), 1 << 16):
        block = every[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(every), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def _segment(fp: Column, i: int, bits: int = 16, low: int = 0) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4) + low).bitwiseAND((1 << bits) - 1)


def _ring_keys(fp: Column) -> Column:
    """20 keys: the table's number above 32 bits of equal segments and halves."""
    keys = []
    for i in range(4):
        parts = [(_segment(fp, i + 1, 8, h), _segment(fp, i + 2, 8, g)) for h in (0, 8) for g in (0, 8)]
        parts.append((_segment(fp, i + 1, 8, 8), _segment(fp, i + 1, 8, 0)))
        for x, y in parts:
            keys.append(
                F.lit(len(keys) << 32).bitwiseOR(
                    F.shiftleft(_segment(fp, i), 16).bitwiseOR(F.shiftleft(x, 8)).bitwiseOR(y)
                )
            )
    return F.array(*keys)


def _nibble_masks() -> list[int]:
    """560 masks of 52 bits, as signed 64-bit numbers."""
    masks = [MASK & ~sum(15 << 4 * n for n in out) for out in combinations(range(16), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, start: int | None) -> list[tuple[int, int]]:
    """Spanning edges among distinct fingerprints at 3 or fewer differing bits.

    start: the segment at which the chain budgets begin; None where the key is no ring key.
    """
    own = np.asarray(fps, dtype=np.int64).view(np.uint64)
    root = list(range(len(own)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for k in range(len(own) - 1):
        differ = own[k + 1 :] ^ own[k]
        near = np.arange(k + 1, len(own))
        if start is not None:
            chain = np.zeros(len(differ), np.int64)
            for length in range(1, 4):
                part = (differ >> np.uint64(16 * ((start + length - 1) % 4))) & np.uint64(0xFFFF)
                chain = chain + np.bitwise_count(part)
                fits = chain <= length * DISTANCE // 4
                differ, near, chain = differ[fits], near[fits], chain[fits]
        near = near[np.bitwise_count(differ) <= DISTANCE]
        for other in near.tolist():
            a, b = find(k), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((k, other))
    own = own.view(np.int64)
    return [(int(own[a]), int(own[b])) for a, b in edges]


@F.pandas_udf(T.ArrayType(T.StructType().add("a", T.LongType()).add("b", T.LongType())))
def _forests(start: pd.Series, fps: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"a": a, "b": b} for a, b in forest(x, None if s < 0 else int(s))] for s, x in zip(start, fps)]
    )


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect what fingerprints (column fp, distinct) at 3 bits connect."""
    keyed = distinct.select("fp", F.explode(_ring_keys(F.col("fp"))).alias("key"))
    large = durable(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    few = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    many = keyed.join(large, "key", "left_semi").select("fp").distinct()
    wide = (
        many.select("fp", F.posexplode(F.array(*[F.lit(m) for m in _nibble_masks()])).alias("table", "mask"))
        .select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        .groupBy("table", "part")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    start = F.floor(F.shiftright("key", 32) / 5).cast("int")
    sets = few.select(start.alias("start"), "fps").union(wide.select(F.lit(-1), "fps"))
    return sets.select(F.explode(_forests("start", "fps")).alias("e")).select("e.a", "e.b")


def rooted(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, root): the class of every fingerprint of the column fp, which is distinct."""
    found = components(links(distinct.select("fp"), bucket))
    return distinct.join(found, distinct.fp == found.node, "left").select(distinct.fp, F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = durable(docs.select("doc_id", _fingerprints("text").alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = distinct.join(rooted(distinct.select("fp"), bucket), "fp")
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@shielded("doc_id", "text")
def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One document of each class, with its own columns: that of the smallest doc_id, null last.

    Among documents of one doc_id in a class, the one whose row has the smallest hash stays; unlike documents
    that share a doc_id are of different classes, and one of each stays. Of equal rows one stays.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, row_hash(docs).alias("__h"))
    prints = durable(keyed.select("doc_id", "__h", _fingerprints("text").alias("fp")))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h")).alias("first"))
    chosen = first.join(rooted(first.select("fp"), bucket), "fp").groupBy("root").agg(F.min("first").alias("first"))
    picked = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.__h").alias("__of"))
    met = keyed.join(picked, (F.col("__h") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return met.dropDuplicates(["__h", "doc_id"]).select(*own)
