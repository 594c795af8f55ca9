"""The jobs from raw messages to their files, ties by ingestion, and smoothing as by a loop."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ampflow import jobs
from ampflow.operators import eda, features, gps, models, quality, trips
from ampflow.operators import timeseries as ts
from ampflow.plans.fixture import DURATIONS, SALT, TRIPS, telemetry
from ampflow.plans.queries import _messages, _stub
from ampflow.schema import Kalman

FOLDER = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The folder of all jobs over the fixture's messages and two without an identifier."""
    out = str(tmp_path_factory.mktemp("jobs"))
    raw = _messages(telemetry(spark, FOLDER))
    odd = spark.createDataFrame([('{"payload": {"status": "Active"}}',), ("no json",)], raw.schema)
    raw.union(odd).coalesce(1).write.csv(f"{out}/raw", header=True, escape='"')
    rows = jobs.ingest(spark, f"{out}/raw", out, SALT)
    jobs.quality_report(rows, out, DURATIONS)
    jobs.soc_models(rows, out, {"stepSize": (0.1,), "maxDepth": (2, 3), "maxIter": (2,)}, DURATIONS)
    jobs.positions(rows, out, _stub, DURATIONS, TRIPS)
    return out


def text(spark, path):
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def test_ingestion_counts_what_it_skips(spark, made):
    n = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert json.loads(text(spark, f"{made}/ingestion")) == {"n_read": n + 2, "n_skipped": 2}
    rows = spark.read.parquet(f"{made}/telemetry")
    assert rows.count() == n == rows.select("ingest_seq").distinct().count() == spark.read.csv(f"{made}/telemetry_csv", header=True).count()


def test_both_reports_are_written(spark, made):
    page = text(spark, f"{made}/quality_report")
    devices = spark.read.parquet(f"{made}/telemetry").select("device_id").distinct().count()
    assert f"<td>{devices}</td>" in page
    assert all(f"<h2>{h}</h2>" in page for h in ("Null rates (%)", "Exact duplicates", "Out of range", "Devices with delayed pings"))
    page = text(spark, f"{made}/gps_report")
    assert "<h2>Anomalies of each device</h2>" in page and "position_jump_rate_pct" in page
    for chart in ("gap_histogram", "correlations", "state_time_share", "heat_map", "map_center", "map_tracks", "gps_summary_long"):
        assert spark.read.parquet(f"{made}/charts/{chart}").count() > 0


def test_models_are_compared_saved_and_read_again(spark, made):
    compared = {r.metric: r for r in spark.read.csv(f"{made}/model_comparison", header=True, inferSchema=True).collect()}
    assert {"rmse", "mae", "r2", "training_sec", "inference_ms_per_sample"} <= compared.keys()
    metrics = json.loads(text(spark, f"{made}/boosted_trees_metrics"))
    assert metrics["settings"]["maxDepth"] in (2, 3) and metrics["cv_mse"] > 0
    assert metrics["rmse"] == pytest.approx(compared["rmse"].trees)
    rows = spark.read.parquet(f"{made}/soc_features").where("is_test = 1")
    again = models.evaluate(models.load(f"{made}/models/boosted_trees"), models.with_missing(rows))
    assert again["rmse"] == pytest.approx(metrics["rmse"])
    weights = spark.read.csv(f"{made}/importances", header=True, inferSchema=True).collect()
    assert sum(r.importance for r in weights) == pytest.approx(1.0)


def test_flags_trips_and_routes(spark, made):
    flags = spark.read.csv(f"{made}/anomaly_flags", header=True, inferSchema=True)
    found = [(r.device_id, r.ts) for r in flags.withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()]
    assert found and found == sorted(found)
    assert flags.select("confidence_score").distinct().count() > 1
    wanted = trips.segment(spark.read.parquet(f"{made}/telemetry"), TRIPS).count()
    for name in ("trip_segments", "trip_carbon_credits", "trip_route_matching"):
        assert spark.read.csv(f"{made}/{name}", header=True).count() == wanted > 0


def test_ties_follow_ingestion(spark):
    rows = [("d", START + dt.timedelta(minutes=i // 2), i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp, ingest_seq long, x double").withColumn(features.TARGET, F.col("x"))
    seqs = features.sequences(df.repartition(5), ("x",), 3, jobs.INGESTED).collect()
    assert sorted([v[0] for v in r.sequence] for r in seqs) == [[i - 2.0, i - 1.0, float(i)] for i in range(2, 12)]
    dealt = features.folds(df.repartition(5), clock=jobs.INGESTED).where("fold = 0").groupBy("role").agg(F.max("x").alias("x")).collect()
    assert {r.role: r.x for r in dealt} == {"train": 2.0, "valid": 5.0}


def test_smoothing_carries_its_state_over_batches(spark):
    rng = random.Random(7)
    rows = []
    for d in ("a", "b", "c"):
        for i in range(50):
            hidden = i < 4 or rng.random() < 0.2
            place = None if hidden else 11 + rng.random() / 10
            rows.append((d, START + dt.timedelta(seconds=i), place, None if i < 2 else 0.0 if rng.random() < 0.1 else 77 + rng.random() / 10))
    df = spark.createDataFrame(rows, "device_id string, ts timestamp, gps_lat double, gps_lon double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.device_id, r.ts): r for r in gps.smooth(df.repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    noise = Kalman()
    for d in ("a", "b", "c"):
        own = [r for r in rows if r[0] == d]
        both = next(r for r in own if r[2] is not None and r[3] is not None)
        for k, name in ((2, "gps_lat_smooth"), (3, "gps_lon_smooth")):
            x, p = both[k], noise.initial
            for r in own:
                p += noise.process
                if r[k] is not None:
                    x, p = x + p / (p + noise.measurement) * (r[k] - x), p * noise.measurement / (p + noise.measurement)
                assert got[d, r[1].replace(tzinfo=None)][name] == pytest.approx(x, abs=1e-9)


def test_rows_without_a_time_count_for_the_delayed_share(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(100)), ("a", None), ("a", None), (None, at(0))]
    got = quality.delayed_devices(spark.createDataFrame(rows, "device_id string, ts timestamp")).collect()
    assert [(r.n_rows, r.n_delayed, r.delayed_ratio) for r in got] == [(4, 1, 0.25)]


def test_the_map_falls_back_to_smoothed_positions(spark):
    columns = "device_id string, ts timestamp, gps_lat double, gps_lon double, gps_lat_smooth double, gps_lon_smooth double"
    df = spark.createDataFrame([("a", START, 1.0, float("nan"), 1.0, 2.0), ("a", START, None, None, 3.0, 4.0)], columns)
    assert eda.map_center(df.withColumn("gps_lon", F.lit(5.0))).first().map_lat == 1.0
    assert eda.map_center(df.where("gps_lat is null")).first().map_lat == 20.0
    assert ts.top_devices(df, 1).first().n == 2
