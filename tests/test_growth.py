"""The tasks of the model's dataset grow in number with its rows, and what several passes read is built once."""

import pytest
from pyspark.sql import functions as F

from ampflow.operators import boosting, features, models, quantiles
from ampflow.operators import timeseries as ts
from ampflow.plans import queries

FOLDER = "/root/testdata/sf0.001"


def sizes(df):
    return df.groupBy(F.spark_partition_id()).count().toPandas()["count"].tolist()


def test_a_larger_dataset_has_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(ts, "TASK_ROWS", 40)
    t = queries.telemetry(spark, FOLDER).persist()
    more = t.union(t.withColumn("device_id", F.concat("device_id", F.lit("+")))).union(t.withColumn("device_id", F.concat("device_id", F.lit("-"))))
    for build in (lambda d: features.soc_dataset(d, queries.DURATIONS), lambda d: features.sequences(features.soc_dataset(d, queries.DURATIONS), length=2)):
        once, thrice = build(t), build(more)
        assert once.rdd.getNumPartitions() >= t.count() / 40 and thrice.rdd.getNumPartitions() >= 3 * t.count() / 40
        assert thrice.count() == 3 * once.count()
        assert max(sizes(thrice)) <= 2 * max(sizes(once)) + 40


def test_neighbours_are_searched_together(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 10)
    asked = []
    held = quantiles._Search.held
    monkeypatch.setattr(quantiles._Search, "held", lambda s: (asked.append((s.rank, s.last)), held(s))[1])
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, {"v": F.col("v")}, (0.5,)) == {"v": [9999.5]}
    assert set(asked[:2]) == {(9999, 10000)}


def test_the_late_times_are_searched_only_without_tails(spark, monkeypatch):
    found = []
    monkeypatch.setattr(features, "exact_quantiles", lambda *a: found.append(a) or quantiles.exact_quantiles(*a))
    rows = spark.createDataFrame([("d", i) for i in range(20)], "device_id string, s long").selectExpr("device_id", "timestamp_seconds(s) AS ts")
    assert features.with_validation(rows).where("is_valid = 1").count() == 3 and not found
    assert features.with_validation(rows, least=30).where("is_valid = 1").count() == 2 and found


def test_a_grid_grows_once_and_a_tree_takes_as_many_passes_as_levels(spark, monkeypatch):
    rows = features.with_split(features.soc_dataset(queries.telemetry(spark, FOLDER), queries.DURATIONS)).where("is_test = 0").cache()
    grown, passes = [], []
    grow, summed = boosting.Trainer.grow, boosting._Spread.summed
    monkeypatch.setattr(boosting.Trainer, "grow", lambda s, *a: grown.append(a) or grow(s, *a))
    monkeypatch.setattr(boosting._Spread, "summed", lambda s, of: passes.append(of.func.__name__) or summed(s, of))
    grid = {"stepSize": (0.1, 0.3), "maxDepth": (2, 3), "maxIter": (2, 4)}
    found = models.train_trees(rows, grid, local_rows=0)
    assert len(grown) == 1 and passes.count("level_sums") == 3 * 4
    alone = {k: (found.settings[k],) for k in grid}
    again = models.train_trees(rows, alone, local_rows=0).model
    assert len(again.trees) == len(found.model.trees)
    assert all((a.feature == b.feature).all() and a.value == pytest.approx(b.value) for a, b in zip(again.trees, found.model.trees))
