"""Isolation forest: an anomaly score from how early random splits isolate a row.

Every tree has a sample of its own: the ``SAMPLE`` rows with the lowest hashes of row and tree. A threshold on the hash lets
about twice as many through where the rows are, so one aggregation by tree finds all samples, and the trees grow in its tasks;
the driver gets trees only. Scoring is an expression-free Arrow pass over all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.operators.quantiles import exact_quantiles

TREES, SAMPLE, SEED = 200, 256, 42


def expected_path(n: float) -> float:
    """The mean depth of a search that fails in a binary tree of n leaves."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, random: np.random.Generator, limit: int) -> np.ndarray:
    """A tree as rows (column, threshold, left, right, path length); a leaf has column -1."""
    nodes: list[list[float]] = []

    def build(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, -1, -1, depth + expected_path(len(part))])
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
        if depth < limit and len(part) > 1 and len(spread):
            column = random.choice(spread)
            cut = random.uniform(part[:, column].min(), part[:, column].max())
            left = part[:, column] < cut
            nodes[at][:2] = column, cut
            nodes[at][2] = build(part[left], depth + 1)
            nodes[at][3] = build(part[~left], depth + 1)
        return at

    build(rows, 0)
    return np.array(nodes)


def paths(trees: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The mean path length of each row."""
    total = np.zeros(len(rows))
    flat, starts = np.ascontiguousarray(rows, float).ravel(), np.arange(len(rows)) * rows.shape[1]
    for tree in trees:
        column, leaf, own = np.maximum(tree[:, 0], 0).astype(np.int64), tree[:, 0] < 0, np.arange(len(tree))
        cut, length = tree[:, 1], tree[:, 4]
        # A leaf leads to itself.
        then = np.where(leaf[:, None], own[:, None], tree[:, [3, 2]].astype(np.int64)).ravel()
        at = np.zeros(len(rows), np.int64)
        while not leaf[at].all():
            at = then[2 * at + (flat[starts + column[at]] < cut[at])]
        total += length[at]
    return total / len(trees)


_score_paths = paths


def confidence(df: DataFrame, columns: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Adds confidence (0 to 1): 1 for the most isolated row, 0 for the least; 0 everywhere if all are alike.

    Nulls of the first column count as 0, those of the others as the column's median. The rows are kept while several passes read
    them, and with their scores afterwards, so that no row is scored twice.
    """
    mine = df.storageLevel == StorageLevel.NONE
    df = df.persist(StorageLevel.MEMORY_AND_DISK) if mine else df
    medians = exact_quantiles(df, {c: F.col(c) for c in columns[1:]}, (0.5,))
    fill = lambda c: F.lit(0.0) if c == columns[0] else F.lit(medians[c][0] or 0.0)
    filled = df.select("*", F.array(*[F.coalesce(F.col(c).cast("double"), fill(c)) for c in columns]).alias("__x"))
    keys = [c for c in ("device_id", "ts") if c in df.columns]
    drawn = samples(filled.select("__x", F.xxhash64("__x", *keys).alias("__h")), trees, sample)
    grown = sorted(drawn.rdd.map(lambda r: (r["tree"], len(r["rows"]), _grown(r["tree"], r["rows"]))).collect(), key=lambda g: g[0])
    if not grown:
        return df.withColumn("confidence", F.lit(0.0))
    size, forest = max(g[1] for g in grown), [g[2] for g in grown]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    unit, mean = expected_path(size) or 1.0, _score_paths

    @F.pandas_udf(T.DoubleType())
    def isolation(x: pd.Series) -> pd.Series:
        return pd.Series(2.0 ** (-mean(shared.value, np.stack(x.to_numpy())) / unit)) if len(x) else pd.Series([], dtype=float)

    scored = filled.select(*df.columns, isolation("__x").alias("__score")).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = map(F.lit, scored.agg(F.min("__score"), F.max("__score")).first())
    if mine:
        df.unpersist()
    return scored.select(*df.columns, _stretched(F.col("__score"), low, high).alias("confidence"))


def samples(rows: DataFrame, trees: int, sample: int) -> DataFrame:
    """(tree, rows): of each tree the __x of the rows with the lowest hashes of __h and the tree; rows of one __h count once."""
    n = rows.count()
    share = min(1.0, 2 * sample / max(1, n))
    below = F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("__h", t).alias("u")))
    low = rows.select("__x", F.explode(F.filter(every, lambda e: e["u"] <= below)).alias("e")).select("e.tree", "e.u", "__x")
    once = low.groupBy("tree", "u").agg(F.first("__x").alias("x"))
    lowest = F.slice(F.sort_array(F.collect_list(F.struct("u", "x"))), 1, sample)
    return once.groupBy("tree").agg(lowest.alias("found")).select("tree", F.transform("found", lambda f: f["x"]).alias("rows"))


def _grown(tree: int, rows: list[list[float]]) -> np.ndarray:
    limit = max(1, math.ceil(math.log2(max(2, len(rows)))))
    return grow(np.array(rows, float), np.random.default_rng((SEED, tree)), limit)


def _stretched(score: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low))))
