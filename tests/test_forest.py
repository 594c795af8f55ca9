"""The isolation forest's samples and scores."""

import pytest
from pyspark.sql import functions as F

from ampflow.operators import forest


def table(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("device_id"), *[F.rand(i).alias(c) for i, c in enumerate("abcd")])
    return rows.withColumns({c: F.when(F.col("device_id") == "7", 50.0).otherwise(F.col(c)) for c in "abcd"})


def test_each_tree_has_a_sample_of_its_own(spark):
    rows = table(spark, 20_000).select(F.array(*"abcd").alias("__x"), F.xxhash64("device_id").alias("__h"))
    found = {r.tree: {tuple(x) for x in r["rows"]} for r in forest.samples(rows.repartition(5), 12, 64).collect()}
    assert sorted(found) == list(range(12)) and all(len(s) == 64 for s in found.values())
    assert len(set.union(*found.values())) > 12 * 64 * 0.9
    again = {r.tree: {tuple(x) for x in r["rows"]} for r in forest.samples(rows.repartition(3), 12, 64).collect()}
    assert again == found


def test_few_and_repeated_rows_are_all_in_every_sample(spark):
    rows = spark.range(10).union(spark.range(3)).select(F.array(F.col("id").cast("double")).alias("__x"), F.xxhash64("id").alias("__h"))
    assert [sorted(x[0] for x in r["rows"]) for r in forest.samples(rows, 3, 64).collect()] == [list(map(float, range(10)))] * 3


def test_the_odd_row_has_the_highest_confidence(spark):
    scored = forest.confidence(table(spark, 3000), tuple("abcd"), trees=60)
    top = scored.orderBy(F.desc("confidence")).first()
    assert top.device_id == "7" and top.confidence == pytest.approx(1.0)
    alike = forest.confidence(spark.range(50).select(*[F.lit(1.0).alias(c) for c in "abcd"]), tuple("abcd"))
    assert alike.select("confidence").distinct().collect()[0][0] == 0.0
    assert forest.confidence(table(spark, 10).where("false"), tuple("abcd")).count() == 0


def test_no_row_is_scored_twice(spark, tmp_path, monkeypatch):
    def noted(trees, rows, paths=forest.paths, folder=str(tmp_path)):
        import tempfile
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
            f.write(str(len(rows)))
        return paths(trees, rows)

    monkeypatch.setattr(forest, "_score_paths", noted)
    assert forest.confidence(table(spark, 500), tuple("abcd"), trees=5).where("confidence >= 0").count() == 500
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 500
