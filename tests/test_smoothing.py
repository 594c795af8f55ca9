"""Smoothing over blocks equals the loop; the map of a stretch is that of its parts."""

import datetime as dt

import numpy as np
import pytest

from ampflow.operators import gps, smoothing
from ampflow.operators.timeseries import Clock
from ampflow.schema import SECOND, Kalman

START = dt.datetime(2024, 1, 1)
COLUMNS = "device_id string, ts timestamp, seq int, gps_lat double, gps_lon double"


def loop(values, x):
    return smoothing.kalman_axis(values, x, Kalman().initial, Kalman())[0]


def test_maps_compose_to_the_state_of_the_loop():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 1001):
        values = 48 + rng.normal(0, 0.01, n)
        values[rng.random(n) < 0.3] = np.nan
        for x, p in ((48.0, 1.0), (47.0, 0.0), (48.2, 1e-5)):
            *_, want_x, want_p = smoothing.kalman_axis([None if np.isnan(v) else v for v in values], x, p, Kalman())
            got = smoothing.after((x, p), tuple(smoothing.composed_all(smoothing.maps(values - 48, Kalman()))), 48.0)
            assert got == pytest.approx((want_x, want_p), abs=1e-11)


@pytest.mark.parametrize("tie", [(), ("seq",)])
def test_blocks_give_what_the_whole_device_gives(spark, tie):
    rng = np.random.default_rng(5)
    rows = []
    for d in "abcd":
        for i in range(400):
            lat = None if i < 30 or rng.random() < 0.2 else 11 + float(rng.random()) / 10
            lon = None if d == "c" or i < 10 else 0.0 if rng.random() < 0.1 else 77 + float(rng.random()) / 10
            at = START + dt.timedelta(seconds=int(i // 2 * 9 if tie else i * 9))
            rows.append((d, at, i, None if d == "d" else lat, None if d == "d" else lon))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    clock = Clock(tie=tie)
    want = {(r.device_id, r.seq): r for r in gps.smooth(df, clock=clock).collect()}
    split = gps.smooth(df, clock=clock, block=500 * SECOND)
    assert split.columns == gps.smooth(df, clock=clock).columns
    got = {(r.device_id, r.seq): r for r in split.collect()}
    assert got.keys() == want.keys() and len(got) == 1600
    for k, r in want.items():
        assert (got[k].gps_lat, got[k].ts) == (r.gps_lat, r.ts)
        assert got[k].gps_lat_smooth == pytest.approx(r.gps_lat_smooth, abs=1e-9)
        assert got[k].gps_lon_smooth == pytest.approx(r.gps_lon_smooth, abs=1e-9)
    assert gps.smooth(df.where("false"), block=SECOND).count() == 0


def test_a_device_of_a_million_rows_uses_several_tasks(spark):
    """The loop over all rows beside the blocks, which more than one task finished."""
    n = 1_000_000
    df = spark.range(n).selectExpr(
        "'a' as device_id", "timestamp_micros(id * 1000000) as ts",
        "case when id % 7 > 0 then 50 + (id * 7919 % 1000) / 1e5 end as gps_lat", "8.0 + id * 1e-7 as gps_lon",
    )
    found = gps.smooth(df, block=3600 * SECOND).selectExpr("*", "spark_partition_id() as task").toPandas().sort_values("ts")
    assert found.task.nunique() > 1 and len(found) == n
    for c in ("gps_lat", "gps_lon"):
        values = [None if np.isnan(v) else v for v in found[c]]
        first = found[c][found.gps_lat.notna()].iloc[0]
        assert np.abs(found[f"{c}_smooth"].to_numpy() - loop(values, first)).max() < 1e-9


def test_short_blocks_are_no_groups_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, starts = smoothing.maps(np.where(rng.random(500) < 0.2, np.nan, rng.normal(size=500)), Kalman()), np.array([0, 1, 2, 9, 10, 300, 499])
    got = smoothing.composed_each(rows, starts)
    want = [smoothing.composed_all(rows[:, a:b]) for a, b in zip(starts, [*starts[1:], 500])]
    assert got == pytest.approx(np.stack(want, axis=1), rel=1e-9)
    df = spark.range(300).selectExpr("cast(id % 60 AS string) AS device_id", "timestamp_seconds(id * 100) AS ts", "11.0 + id / 1e4 AS gps_lat", "76.0 - id / 1e4 AS gps_lon")
    plan = gps.smooth(df, block=3600 * SECOND)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
