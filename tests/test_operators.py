import json
import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ampflow.operators import features, gps, mapmatch, quality, trips
from ampflow.operators import timeseries as ts
from ampflow.schema import CANONICAL, MINUTE, SECOND, TripRules
from ampflow.sources import messages, sinks

START = datetime(2026, 2, 1, tzinfo=timezone.utc)


def pings(spark, rows):
    """rows: (device, seconds, dict of other columns)."""
    full = [{f.name: None for f in CANONICAL} | {"device_id": d, "ts": START + timedelta(seconds=s)} | x for d, s, x in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in CANONICAL) for r in full], CANONICAL)


def drive(speed, state="Discharging", status="Active", **more):
    return {"gps_speed_kmh": speed, "battery_state": state, "device_status": status, "gps_delta_km": 0.05} | more


def random_pings(seed, n=150):
    rng = random.Random(seed)
    rows, now = [], 0
    for _ in range(n):
        now += rng.choice([10, 30, 60, 90, 200])
        speed = rng.choice([None, 0.0, 0.0, 1.0, 5.0, 30.0])
        rows.append(("a", now, drive(speed, rng.choice(["Discharging"] * 6 + ["Charging", None]), rng.choice(["Active"] * 5 + ["Inactive"]))))
    return rows


def walked(rows, least_km):
    """Trips by a plain loop: (first second, last second, km)."""
    found, inside, stop, before = [], None, 0.0, None
    for _, s, x in rows:
        speed = x["gps_speed_kmh"]
        stop = stop + (s - before if before is not None else 0) if (speed or 0.0) <= 0 else 0.0
        before = s
        if inside is None and speed is not None and speed > 2 and x["battery_state"] == "Discharging" and x["device_status"] == "Active":
            inside = [s, s, x["gps_delta_km"]]
        elif inside is not None:
            inside[1], inside[2] = s, inside[2] + x["gps_delta_km"]
            if x["battery_state"] == "Charging" or stop >= 180:
                if inside[2] >= least_km:
                    found.append(tuple(inside))
                inside = None
    return found


@pytest.mark.parametrize("seed", range(3))
def test_trips_as_by_a_loop(spark, seed):
    rows = random_pings(seed)
    got = trips.segment(pings(spark, rows)).orderBy("start_ts").collect()
    want = walked(rows, 0.1)
    seconds = lambda t: int((t.replace(tzinfo=timezone.utc) - START).total_seconds())
    assert [(seconds(r.start_ts), seconds(r.end_ts)) for r in got] == [w[:2] for w in want]
    assert [r.distance_km for r in got] == pytest.approx([w[2] for w in want])
    assert [r.trip_id for r in got] == [f"a_{i + 1}" for i in range(len(want))]


def test_a_stop_ends_a_trip_at_180_seconds(spark):
    for wait, n in ((179, 0), (180, 1)):
        rows = [("a", 0, drive(10.0)), ("a", 30, drive(10.0)), ("a", 30 + wait, drive(0.0))]
        assert trips.segment(pings(spark, rows)).count() == n


def test_rules_that_overlap_are_refused():
    with pytest.raises(ValueError):
        TripRules(start_speed_kmh=1.0, stop_speed_kmh=1.0)


def test_published_carbon_credit(spark):
    one = spark.createDataFrame([(905009.04, 127.91)], "energy_consumed_wh double, distance_km double")
    assert trips.with_carbon(one).first().net_tco2e == pytest.approx(647.96728614)


def test_published_rates(spark):
    rows = [("a", 0, {}), ("b", 0, {})]
    flagged = pings(spark, rows).select("device_id", F.explode(F.sequence(F.lit(1), F.lit(7629))).alias("i")).select(
        "device_id", (F.col("i") <= 76).alias(gps.FLAGS[0]), (F.col("i") <= 66).alias(gps.FLAGS[1]), (F.col("i") <= 713).alias(gps.FLAGS[2])
    )
    got = gps.summary(flagged).first()
    assert (got.position_jump_rate_pct, got.signal_dropout_rate_pct, got.coordinate_freeze_rate_pct) == (0.996, 0.865, 9.346)


def test_freeze_starts_at_the_sixth_equal_fix(spark):
    rows = [("a", 30 * i, {"gps_lat": 11.0, "gps_lon": 76.0, "gps_speed_kmh": 5.0}) for i in range(7)]
    got = [r[gps.FLAGS[2]] for r in gps.detect(pings(spark, rows)).orderBy("ts").collect()]
    assert got == [False] * 5 + [True] * 2


def test_jump_needs_a_known_place_and_under_30_seconds(spark):
    far = {"gps_lat": 12.0, "gps_lon": 76.0}
    near = {"gps_lat": 11.0, "gps_lon": 76.0}
    rows = [("a", 0, near), ("a", 29, far), ("a", 59, near), ("a", 60, {}), ("a", 61, far)]
    got = [r[gps.FLAGS[0]] for r in gps.detect(pings(spark, rows)).orderBy("ts").collect()]
    assert got == [False, True, False, False, False]


def test_rolling_with_ties_as_by_a_loop(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice([None, 1.0, 2.0, 7.5])) for s in sorted(rng.choices(range(60), k=60))]
    df = pings(spark, [("a", s, {"battery_temp_c": v, "gps_total_km": float(i)}) for i, (s, v) in enumerate(rows)])
    clock = ts.Clock(tie=("gps_total_km",))
    wanted = [
        ts.Rolling("mean", F.col("battery_temp_c"), "avg", 10 * SECOND, 2),
        ts.Rolling("dev", F.col("battery_temp_c"), "std", 10 * SECOND, 2),
        ts.Rolling("top", F.col("battery_temp_c"), "max", 10 * SECOND, 2),
    ]
    got = ts.with_rolling(clock.keyed(df), clock, wanted).orderBy("gps_total_km").collect()
    for i, (s, _) in enumerate(rows):
        inside = [v for t, v in rows[: i + 1] if s - 10 < t and v is not None]
        if len(inside) < 2:
            assert got[i].mean is None and got[i].dev is None and got[i].top is None
            continue
        mean = sum(inside) / len(inside)
        assert got[i].mean == pytest.approx(mean)
        assert got[i].dev == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in inside) / (len(inside) - 1)), abs=1e-6)
        assert got[i].top == max(inside)


def test_asof_keeps_a_null_of_the_row_it_finds(spark):
    rows = [("a", 0, {"battery_soc_pct": 50.0}), ("a", 60, {}), ("a", 400, {"battery_soc_pct": 40.0})]
    keyed = ts.PLAIN.keyed(pings(spark, rows))
    got = keyed.select("ts", ts.asof("battery_soc_pct", ts.PLAIN.until(5 * MINUTE), 5 * MINUTE).alias("v")).orderBy("ts").collect()
    assert [r.v for r in got] == [None, None, None]


def test_kalman_without_any_fix_stays_at_zero(spark):
    got = gps.smooth(pings(spark, [("a", 0, {}), ("a", 30, {})]).select("device_id", "ts", "gps_lat", "gps_lon")).collect()
    assert {(r.gps_lat_smooth, r.gps_lon_smooth) for r in got} == {(0.0, 0.0)}


def test_near_duplicates_at_exactly_one_second(spark):
    assert quality.near_duplicates(pings(spark, [("a", 0, {}), ("a", 1, {}), ("a", 3, {})])).first()[0] == 1


def test_empty_telemetry(spark):
    none = pings(spark, [])
    for made in (trips.segment(none), gps.detect(none), features.soc_dataset(none), quality.gap_histogram(none), features.folds(none)):
        assert made.count() == 0
    assert quality.overview(none).first().n_rows == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="battery_soc_pct"):
        features.require(spark.range(1))


def test_map_matching_retries_with_fewer_points(spark):
    assert mapmatch.thinned(list(range(60)), 4) == [0, 20, 39, 59]
    tracks = spark.createDataFrame([("a", "a_1", [(11.0 + i / 1000, 76.0) for i in range(45)])], "device_id string, trip_id string, points array<struct<lat double, lon double>>")
    got = mapmatch.match(tracks, lambda p: (None, 0.0, "http_400:x") if len(p) > 20 else (1.5, 0.8, "ok")).first()
    assert (got.matched_route_km, got.match_status) == (1.5, "ok")
    assert got.raw_gps_km == pytest.approx(44 * 0.111195, rel=1e-3)


def message(**root):
    return json.dumps(root)


def test_ingestion_of_odd_messages(spark):
    whole = {"deviceId": 123, "imei": "i", "gps": {"gpsLatitude": "11.5"}, "battery": {"batterySoc": 80}}
    rows = [
        "not json", "[1]", '"text"', None,
        message(timestamp=1770000000123, payload=whole),
        message(timestamp=1770000000, payload=whole),
        message(ts="2026-02-02T02:40:00Z", payload={"imei": "only"}),
        message(timestamp="soon", payload={"deviceId": "x", "gps": [1]}),
        message(timestamp=1, payload={"status": "no id"}),
        message(payload={"deviceId": "y", "lastPingTime": 1770000000123, "battery": {"batterySoc": "NaN", "batterySoh": "bad"}}),
    ]
    df = spark.createDataFrame([(r,) for r in rows], "PayLoad string")
    got = messages.canonical(df, "s").collect()
    assert len(got) == 5
    assert got[0].gps_lat == 11.5 and got[0].battery_soc_pct == 80.0 and got[0].ts.microsecond == 123000
    assert got[1].ts == got[0].ts.replace(microsecond=0)
    assert got[2].device_id == got[2].imei_token and got[2].ts is not None
    assert got[3].ts is None and got[3].gps_lat is None
    assert got[4].ts == got[4].last_ping_time and got[4].battery_soc_pct is None and got[4].battery_soh_pct is None


def test_csv_round_trip_and_payload_column(spark, tmp_path):
    path = tmp_path / "raw.csv"
    text = message(timestamp=1770000000123, payload={"deviceId": "a", "status": 'say "hi"'})
    path.write_text('PAYLOAD,ts\n"' + text.replace('"', '""') + '",x\n')
    got = messages.canonical(messages.read_messages(spark, str(path))).collect()
    assert len(got) == 1 and got[0].device_status == 'say "hi"'
    with pytest.raises(ValueError):
        messages.payload_column(spark.range(1))
    sinks.write_csv(messages.enforced(spark.createDataFrame(got, CANONICAL)), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_html_report_escapes(spark):
    page = sinks.html_report("R", {"part": spark.createDataFrame([("<b>", None)], "a string, b string")})
    assert "&lt;b&gt;" in page and "<td></td>" in page


@pytest.mark.parametrize("n,most", [(3, 4), (4, 4), (5, 4), (37, 4), (120, 50)])
def test_tracks_are_thinned_at_even_steps(spark, n, most):
    rows = [("a", "a_1", i, 11.0 + i / 1000, 76.0) for i in range(n)]
    points = spark.createDataFrame(rows, f"device_id string, trip_id string, {ts.KEY} long, gps_lat double, gps_lon double")
    kept = sorted({round(j * (n - 1) / (most - 1)) for j in range(most)}) if n > most else range(n)
    assert [p.lat for p in trips.tracks(points, most).first().points] == [rows[i][3] for i in kept]


def test_rolling_over_a_long_history_keeps_its_digits(spark):
    """Windows of two widths over several blocks, gaps of more than a block, and large values long before."""
    rng = random.Random(11)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([1, 2, 3, 3, 40, 95])
        rows.append((at, 1e12 if i == 3 else rng.choice([None, 1.0, 2.0, 7.5])))
    df = pings(spark, [("a", s, {"battery_temp_c": v}) for s, v in rows])
    wanted = [ts.Rolling(f"{k}_{w}", F.col("battery_temp_c"), k, w * SECOND, 2) for k in ("avg", "std") for w in (30, 7)]
    got = ts.with_rolling(ts.PLAIN.keyed(df), ts.PLAIN, wanted).orderBy("ts").collect()
    checked = 0
    for i, (s, _) in enumerate(rows):
        for w in (30, 7):
            inside = [v for t, v in rows[: i + 1] if s - w < t and v is not None]
            if len(inside) < 2 or max(inside) > 100:
                continue
            mean = sum(inside) / len(inside)
            dev = math.sqrt(sum((v - mean) ** 2 for v in inside) / (len(inside) - 1))
            if s > rows[3][0] + 60:
                assert got[i][f"avg_{w}"] == pytest.approx(mean, abs=1e-9) and got[i][f"std_{w}"] == pytest.approx(dev, abs=1e-7)
                checked += 1
    assert checked > 200
