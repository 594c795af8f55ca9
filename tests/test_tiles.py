"""The tiles of the heat map."""

from collections import Counter
from math import floor

import pytest

from ampflow.operators import eda

PLACES = [(11.234, 76.567), (11.2345, 76.5678), (-0.001, -179.999), (89.999, 10.0), (0.0, 5.0), (None, 5.0), (float("nan"), 5.0), (95.0, 5.0), (12.0, 12.0)]


def test_every_level_counts_every_place_once(spark):
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(PLACES)], "gps_lat double, gps_lon double, i int")
    rows = eda.heat_tiles(df, 4).collect()
    inside = [(a, b) for a, b in PLACES if a and b and -90 <= a <= 90]
    for level in range(4):
        size = 10.0 ** (level - 2)
        want = Counter((floor(floor(a * 100) / 10**level), floor(floor(b * 100) / 10**level)) for a, b in inside)
        got = {(round(r.south / size), round(r.west / size)): r.n for r in rows if r.level == level}
        assert got == want and sum(got.values()) == len(inside)
        assert all(r["size"] == pytest.approx(size) for r in rows if r.level == level)


def test_no_place_gives_no_tile(spark):
    assert eda.heat_tiles(spark.createDataFrame([(0.0, 1.0)], "gps_lat double, gps_lon double")).count() == 0
