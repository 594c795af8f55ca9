"""Long devices split over tasks: the same results as from one window partition a device."""

import pytest
from pyspark.sql import functions as F

from ampflow.operators import anomaly, features
from ampflow.operators import timeseries as ts
from ampflow.plans import queries
from ampflow.plans.queries import DURATIONS
from ampflow.schema import DAY, SECOND
from tests.test_clock import TIED, in_order, random_rows, table

FOLDER = "/root/testdata/sf0.001"
BLOCKS = (8 * DAY, 9 * DAY, 40 * DAY)


@pytest.fixture(scope="module")
def one(spark):
    """All events as one device, and a column that orders ties."""
    rows = queries.telemetry(spark, FOLDER)
    return rows.select("*", F.xxhash64("device_id", "ts", "gps_total_km").alias("seq")).withColumn("device_id", F.lit("d")).cache()


def alike(a, b):
    """Equal rows; doubles may differ in their last digits, as sums add up in another order."""
    a, b = (df.orderBy("ts", "seq").collect() for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(v == pytest.approx(w, rel=1e-9, abs=1e-6) if isinstance(v, float) and w is not None else v == w for v, w in zip(x, y))


@pytest.mark.parametrize("block", BLOCKS)
def test_dataset_and_anomalies_do_not_change(one, block):
    whole = features.soc_dataset(one, DURATIONS, TIED)
    parts = features.soc_dataset(one, DURATIONS, TIED, block=block)
    assert parts.columns == whole.columns
    alike(parts, whole)
    whole, parts = (anomaly.prepared(one, DURATIONS, TIED, b).drop(ts.KEY) for b in (None, block))
    assert parts.columns == whole.columns
    alike(parts, whole)


def test_one_device_is_many_window_partitions(spark, one):
    rows, clock = ts.spread(TIED.keyed(one), TIED, 7 * DAY, DAY)
    assert clock.by == ["device_id", ts.PART]
    dealt = rows.repartition(8, *clock.by).select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 2 and ts.gathered(rows).count() == one.count()


@pytest.mark.parametrize("block", [1, 4, 33, 1000])
@pytest.mark.parametrize("tied", [False, True])
def test_gaps_and_lookups_over_sparse_blocks(spark, block, tied):
    rows, clock = random_rows(block, tied), TIED if tied else ts.PLAIN
    reach = min(block, 20)
    keyed, split = ts.spread(clock.keyed(table(spark, rows)), clock, block, reach, reach)
    back, ahead = (ts.asof("v", r, reach) for r in (split.until(reach), split.after(reach)))
    found = keyed.select("*", back.alias("b"), ahead.alias("f"), F.lag("v").over(split.window).alias("l"))
    got = {r.seq: r for r in ts.gathered(found).collect()}
    gaps = {r.seq: r.gap_sec for r in ts.with_gap(table(spark, rows), clock, block=block).collect()}
    for own in in_order(rows).values():
        for k, (us, seq, _) in enumerate(own):
            before = [x for x in own if x[0] <= us - reach]
            after = [x for x in own if x[0] >= us + reach]
            assert got[seq].b == (before[-1][2] if before else None)
            assert got[seq].f == (after[0][2] if after else None)
            assert got[seq].l == (own[k - 1][2] if k else None)
            assert gaps[seq] == (pytest.approx((us - own[k - 1][0]) / SECOND) if k else None)


def test_reaching_over_a_block_is_refused(spark):
    with pytest.raises(ValueError):
        ts.spread(ts.PLAIN.keyed(table(spark, [("a", 0, 1.0)])), ts.PLAIN, 5, 6)
