"""Capacity, matching, ties and report tables on hand-made rows."""

import datetime as dt
import io
import json
import urllib.request

import pytest
from pyspark.sql import functions as F

from ampflow.operators import eda, features, mapmatch, quality
from ampflow.operators import timeseries as ts
from ampflow.schema import CANONICAL
from ampflow.sources import sinks

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def telemetry(spark, rows):
    """Rows of (minutes, other columns); the rest is null."""
    return spark.createDataFrame(
        [tuple({"device_id": "d", "ts": START + dt.timedelta(minutes=m), **v}.get(f.name) for f in CANONICAL) for m, v in rows], CANONICAL
    )


def test_energy_uses_the_usable_capacity(spark):
    base = {"battery_capacity_ah": 40.0, "battery_usable_ah": 30.0, "battery_voltage_v": 50.0, "battery_soh_pct": 90.0, "capacity_charge_ah": 6.0, "gps_speed_kmh": 0.0}
    df = telemetry(spark, [(0, base | {"battery_soc_pct": 80.0}), (5, base | {"battery_soc_pct": 78.0}), (15, base | {"battery_soc_pct": 75.0})])
    got = {r.ts.minute: r for r in features.soc_dataset(df).collect()}
    row = got[5]
    assert row.discharge_rate_wh == -2.0 * 30.0 * 50.0 * 10.0 == row.idle_drain
    assert row.soh_adjusted_cap == pytest.approx(27.0) and row.charge_headroom == pytest.approx(0.2)


def test_critical_columns(spark):
    rates = quality.null_rates(telemetry(spark, [(0, {"gps_lat": 1.0, "gps_lon": 1.0, "battery_soc_pct": 5.0}), (1, {})]))
    assert {r["column"] for r in quality.critical_nulls(rates).collect()} == {"battery_voltage_v", "battery_soc_pct", "gps_lat", "gps_lon"}


def test_too_many_rows_of_one_time_are_an_error(spark):
    df = spark.range(ts.TIES + 1).select(F.lit("d").alias("device_id"), F.lit(START).alias("ts"), "id")
    assert ts.Clock(("id",)).keyed(df.limit(ts.TIES)).count() == ts.TIES
    with pytest.raises(Exception, match="more than 1024 rows"):
        ts.Clock(("id",)).keyed(df).agg(F.max(ts.KEY)).collect()


def test_every_trip_has_a_row_and_smoothed_positions_count(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = spark.createDataFrame(
        [("d", at(0), 0.0, 0.0, 1.0, 1.0), ("d", at(1), 5.0, 5.0, 1.0, 1.01)],
        "device_id string, ts timestamp, gps_lat double, gps_lon double, gps_lat_smooth double, gps_lon_smooth double",
    )
    trips = spark.createDataFrame([("d", "d_1", at(0), at(2)), ("d", "d_2", at(5), at(6))], "device_id string, trip_id string, start_ts timestamp, end_ts timestamp")
    got = {r.trip_id: r for r in mapmatch.match_trips(rows, trips, lambda p: (2.0, 0.5, "ok")).collect()}
    assert got["d_1"].raw_gps_km == pytest.approx(1.112, abs=0.01) and got["d_1"].matched_route_km == 2.0
    assert (got["d_2"].raw_gps_km, got["d_2"].matched_route_km, got["d_2"].match_status) == (0.0, None, "too_few_points")


@pytest.mark.parametrize("answer,want", [
    ({"code": "Ok", "matchings": [{"distance": 1500, "confidence": 0.4}, {"distance": 9, "confidence": 0.9}]}, (1.5, 0.4, "ok")),
    ({"code": "NoMatch", "matchings": [{"distance": 1}]}, (None, 0.0, "osrm_NoMatch")),
    ({"code": "Ok", "matchings": []}, (None, 0.0, "no_matchings")),
    ({"code": "Ok", "matchings": [{"confidence": 0.3}]}, (None, 0.3, "missing_distance")),
    ([], (None, 0.0, "osrm_invalid_json")),
])
def test_answers_of_the_matcher(monkeypatch, answer, want):
    monkeypatch.setattr(urllib.request, "urlopen", lambda *a, **k: io.StringIO(json.dumps(answer)))
    assert mapmatch.http_matcher("http://localhost")([(0.0, 0.0), (1.0, 1.0)]) == want


def test_a_cut_table_says_so(spark):
    page = sinks.html_table(spark.range(5), most=3)
    assert page.count("<td>") == 3 and "The first 3 of 5 rows." in page
    assert "The first" not in sinks.html_table(spark.range(3), most=3)


def test_correlations_of_constants_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.5, 7.0), (None, 1.0, 7.0)], "a double, b double, c double")
    got = {(r.battery_column, r.gps_column): r["corr"] for r in eda.correlation_matrix(df, ("a",), ("b", "c")).collect()}
    assert got["a", "b"] == pytest.approx(0.9979, abs=1e-3) and got["a", "c"] is None
    assert eda.correlation_matrix(df.where("false"), ("a",), ("b",)).collect()[0]["corr"] is None
