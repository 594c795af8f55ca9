"""Shapley values of boosted trees: what each feature adds to a prediction, exactly.

The value of a set of features is the tree's expected output when only they are known: a split on one of them is followed, any
other is taken both ways, weighted by the training rows that went there. For one leaf only the features on its path matter. If
the row fits all the path's splits on a feature (o = 1, else 0) and z is the share of rows that those splits let through,
the leaf's output times the product of o or z is its part in a set's value; so the Shapley sums come from the coefficients of the product
of (z + o t) over the other features of the path. Work is leaves times depth squared, not sets, and all rows of a batch go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.operators.boosting import MISSING, BoostedTrees, Tree, binned


def _leaves(tree: Tree) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf that rows reached, with its path: (node, whether it goes left)."""
    waiting: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
    while waiting:
        at, path = waiting.pop()
        if tree.feature[at] < 0:
            yield at, path
        else:
            waiting += [(2 * at + 1, [*path, (at, True)]), (2 * at + 2, [*path, (at, False)])]


def tree_values(tree: Tree, bins: np.ndarray) -> tuple[np.ndarray, float]:
    """(Shapley values (rows, features), the value of knowing nothing)."""
    values, base = np.zeros(bins.shape), 0.0
    for leaf, path in _leaves(tree):
        share: dict[int, float] = {}
        fits: dict[int, np.ndarray] = {}
        for node, left in path:
            f = int(tree.feature[node])
            child = 2 * node + (1 if left else 2)
            b = bins[:, f]
            goes_left = np.where(b == MISSING, tree.missing_left[node], b <= tree.cut[node])
            share[f] = share.get(f, 1.0) * tree.cover[child] / tree.cover[node]
            fits[f] = fits.get(f, True) & (goes_left == left)
        value, n = tree.value[leaf], len(share)
        base += value * np.prod(list(share.values()))
        for f in share:
            product = [np.ones(len(bins))]
            for g in share:
                if g != f:  # times (z + o t)
                    product = [
                        (product[k] * share[g] if k < len(product) else 0.0) + (product[k - 1] * fits[g] if k else 0.0)
                        for k in range(len(product) + 1)
                    ]
            weight = sum(c * (factorial(k) * factorial(n - 1 - k) / factorial(n)) for k, c in enumerate(product))
            values[:, f] += value * (fits[f] - share[f]) * weight
    return values, base


def model_values(model: BoostedTrees, bins: np.ndarray) -> tuple[np.ndarray, float]:
    """(values, base) of a model: base and a row's values add up to its prediction."""
    total, base = np.zeros(bins.shape), model.base
    for tree in model.trees:
        values, own = tree_values(tree, bins)
        total += values
        base += own
    return total, base


def with_values(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """Adds shap_base and shap_values (array<double>, in the order of the model's features) to every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, base = model_values(sent.value, binned(batch, sent.value.features, sent.value.edges))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), pa.float64()), values.shape[1]).cast(pa.list_(pa.float64()))
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, base)), lists]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shap_base", "shap_values"])

    added = [T.StructField("shap_base", T.DoubleType()), T.StructField("shap_values", T.ArrayType(T.DoubleType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def sample(df: DataFrame, keys: tuple[str, ...], n: int = 2000) -> DataFrame:
    """The n rows with the lowest hashes of their keys: the same in every run."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def summary(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap, mean_shap) over the rows."""
    names = F.array(*[F.lit(c) for c in model.features])
    pairs = with_values(model, df.select(*model.features)).select(F.explode(F.arrays_zip(names.alias("feature"), F.col("shap_values").alias("v"))).alias("p"))
    rows = pairs.select("p.feature", "p.v")
    return rows.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs_shap"), F.avg("v").alias("mean_shap"))
