"""Frames of the clocks and rolling aggregates against plain loops, with ties and microseconds."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ampflow.operators import timeseries as ts
from ampflow.schema import SECOND

START = dt.datetime(2025, 1, 1)
TIED = ts.Clock(tie=("seq",))


def table(spark, rows):
    full = [(d, START + dt.timedelta(microseconds=us), seq, v) for seq, (d, us, v) in enumerate(rows)]
    return spark.createDataFrame(full, "device_id string, ts timestamp, seq long, v double").repartition(5)


def in_order(rows):
    """Of each device, (us, seq, v) in order."""
    out = {}
    for seq, (d, us, v) in enumerate(rows):
        out.setdefault(d, []).append((us, seq, v))
    return {d: sorted(r, key=lambda x: x[:2]) for d, r in out.items()}


def rolled(spark, rows, clock, wanted):
    df = ts.with_rolling(clock.keyed(table(spark, rows)), clock, wanted)
    return {r.seq: r for r in df.collect()}


def test_a_maximum_that_came_microseconds_later_counts(spark):
    rows = [("a", 0, 5.0), ("a", 400, 9.0), ("a", 60 * SECOND, 1.0)]
    for clock in (ts.PLAIN, TIED):
        got = rolled(spark, rows, clock, [ts.Rolling("m", F.col("v"), "max", 60 * SECOND, 1)])
        assert [got[i].m for i in range(3)] == [5.0, 9.0, 9.0]


def random_rows(seed, tied):
    rng = random.Random(seed)
    rows = []
    for d in ("a", "b", "c"):
        us = -3
        for _ in range(150):
            us += rng.choice([0, 0, 1, 2, 5, 30] if tied else [1, 2, 5, 30])
            rows.append((d, us, None if rng.random() < 0.15 else round(rng.uniform(-5, 5), 3)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("width", [1, 7, 40, 10_000])
def test_rolling_as_loops(spark, tied, width):
    rows, clock = random_rows(width, tied), TIED if tied else ts.PLAIN
    wanted = [ts.Rolling("m", F.col("v"), "max", width, 2), ts.Rolling("a", F.col("v"), "avg", width, 2), ts.Rolling("s", F.col("v"), "std", 3 * width, 3)]
    got = rolled(spark, rows, clock, wanted)
    for own in in_order(rows).values():
        for k, (us, seq, _) in enumerate(own):
            seen = lambda w: [v for u, _, v in own[: k + 1] if u > us - w and v is not None]
            near, far = seen(width), seen(3 * width)
            assert got[seq].m == (max(near) if len(near) >= 2 else None)
            assert (got[seq].a is None) == (len(near) < 2) and (len(near) < 2 or got[seq].a == pytest.approx(statistics.fmean(near), abs=1e-9))
            assert (got[seq].s is None) == (len(far) < 3) and (len(far) < 3 or got[seq].s == pytest.approx(statistics.stdev(far), abs=1e-6))


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("distance", [1, 6, 50])
def test_asof_as_loops(spark, tied, distance):
    rows, clock = random_rows(100 + distance, tied), TIED if tied else ts.PLAIN
    keyed = clock.keyed(table(spark, rows))
    near = ts.asof("v", clock.until(distance), distance, 3)
    got = {r.seq: r for r in keyed.select("seq", ts.asof("v", clock.until(distance), distance).alias("b"), ts.asof("v", clock.after(distance), distance).alias("f"), near.alias("n")).collect()}
    for own in in_order(rows).values():
        for us, seq, _ in own:
            before = [x for x in own if x[0] <= us - distance]
            after = [x for x in own if x[0] >= us + distance]
            assert got[seq].b == (before[-1][2] if before else None)
            assert got[seq].f == (after[0][2] if after else None)
            assert got[seq].n == (before[-1][2] if before and us - before[-1][0] <= distance + 3 else None)


def test_the_plan_of_a_maximum_has_no_sliding_frame(spark):
    df = ts.with_rolling(TIED.keyed(table(spark, random_rows(1, True))), TIED, [ts.Rolling("m", F.col("v"), "max", 50, 1)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    frames = [line for line in plan.split("specifiedwindowframe")[1:]]
    assert frames and all("unboundedpreceding" in f[:60] for f in frames)
    assert plan.count("Exchange hashpartitioning") <= 1
