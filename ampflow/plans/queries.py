"""The registered queries: each applies one operator to the whole telemetry of the fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.functions.geo import haversine_km
from ampflow.operators import anomaly, attribution, eda, features, forest, gps, mapmatch, models, quality, recurrent, trips
from ampflow.operators import timeseries as ts
from ampflow.plans.fixture import DURATIONS, SALT, TRIPS, telemetry
from ampflow.schema import BATTERY_FIELDS, FEATURES, GPS_FIELDS, SECOND
from ampflow.sources import messages

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = ts.PLAIN
#: A long device is smoothed in blocks of so many microseconds.
WEEK = 7 * 24 * 3600 * SECOND
#: Positions that the road matcher takes of a trip.
TRACK_POINTS = 50


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero; so that engines that add in another order agree."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _messages(t: DataFrame) -> DataFrame:
    """The telemetry as raw messages: one JSON text a row, all leaves text, times in milliseconds."""
    leaf = lambda pairs: F.struct(*[F.col(c).cast("string").alias(f) for c, f in pairs.items()])
    millis = F.unix_millis("ts").cast("string")
    payload = F.struct(
        F.col("device_id").alias("deviceId"),
        F.col("imei_token").alias("imei"),
        F.col("device_status").alias("status"),
        F.unix_millis("last_ping_time").cast("string").alias("lastPingTime"),
        leaf(GPS_FIELDS).alias("gps"),
        leaf(BATTERY_FIELDS).alias("battery"),
    )
    return t.select(F.to_json(F.struct(millis.alias("timestamp"), payload.alias("payload"))).alias("Payload"))


def _stub(points: list[tuple[float, float]]) -> tuple[float, float, str]:
    """A matcher without a network: the route is a tenth longer than the straight steps."""
    from math import asin, cos, radians, sin, sqrt

    km = 0.0
    for (a, b), (c, d) in zip(points, points[1:]):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        km += 2 * 6371.0088 * asin(min(1.0, sqrt(h)))
    return km * 1.1, 0.9, "ok"


def _keyed(t: DataFrame) -> DataFrame:
    return PLAIN.keyed(t)


def _flagged(t: DataFrame) -> DataFrame:
    return gps.detect(t, DURATIONS.jump, least_run=2)


def _soc(t: DataFrame) -> DataFrame:
    return features.soc_dataset(t, DURATIONS)


def _tracks(t: DataFrame) -> DataFrame:
    return trips.tracks(trips.points_of_trips(t, trips.segment(t, TRIPS)), TRACK_POINTS)


def _ahead():
    return ts.asof("battery_soc_pct", PLAIN.after(DURATIONS.horizon), DURATIONS.horizon)


def _sequence_digest(seqs: DataFrame) -> DataFrame:
    total = F.aggregate(
        "sequence", F.lit(0.0), lambda a, row: a + F.aggregate(row, F.lit(0.0), lambda b, x: b + F.coalesce(x, F.lit(0.0)))
    )
    imbalance = F.transform("sequence", lambda row: F.round(row[FEATURES.index("cell_imbalance")], 6).cast("string"))
    return seqs.withColumn("total", F.round(total, 3)).withColumn("imbalances", F.array_join(imbalance, ","))


def _over(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(f(telemetry(spark, sf_dir)))


def _forest_confidence(t: DataFrame) -> DataFrame:
    rows = anomaly.prepared(t, DURATIONS).select("device_id", "ts", *anomaly.SCORED)
    return forest.confidence(rows, anomaly.SCORED).select("device_id", "ts", "confidence")


def _boosted(t: DataFrame) -> DataFrame:
    """Held-out predictions of boosted trees with fixed settings."""
    return _held_out(t, {"stepSize": (0.1,), "maxDepth": (4,), "maxIter": (10,)})


def _split(t: DataFrame) -> DataFrame:
    """The dataset and its split, kept, as several passes read it."""
    return features.with_split(_soc(t)).persist(StorageLevel.MEMORY_AND_DISK)


def _held_out(t: DataFrame, grid: dict[str, tuple]) -> DataFrame:
    rows = _split(t)
    model = models.train_trees(rows.where("is_test = 0"), grid).model
    test = rows.where("is_test = 1").select("device_id", "ts", *FEATURES, features.TARGET)
    return model.transform(test).select("device_id", "ts", features.TARGET, "prediction")


def _shapley(t: DataFrame) -> DataFrame:
    """What each feature adds to the predictions of boosted trees, over 2,000 held-out rows."""
    rows = _split(t)
    model = models.train_trees(rows.where("is_test = 0"), {"stepSize": (0.1,), "maxDepth": (4,), "maxIter": (10,)}).model
    return attribution.summary(model, attribution.sample(rows.where("is_test = 1"), ("device_id", "ts")))


def _boosted_grid(t: DataFrame, grid: dict[str, tuple] = models.GRID) -> DataFrame:
    """Held-out predictions of boosted trees with the best settings of a grid over expanding folds."""
    return _held_out(t, grid)


def _sequence_model(t: DataFrame) -> DataFrame:
    """Held-out predictions of the recurrent sequence model."""
    learns, test = _sequences(t)
    return recurrent.train(features.with_validation(learns), features.TARGET).transform(test).select("device_id", "ts", features.TARGET, "prediction")


def _sequence_baseline(t: DataFrame) -> DataFrame:
    """Held-out predictions of a ridge regression over the same sequences."""
    learns, test = _sequences(t)
    model = models.train_sequences(learns)
    return model.transform(models.flattened(test)).select("device_id", "ts", features.TARGET, "prediction")


def _sequences(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences of the training and of the held-out rows, standardised alike."""
    rows = _split(t)
    scaled = features.standardised(rows.where("is_test = 0"), rows)
    return tuple(features.sequences(scaled.where(f"is_test = {part}")) for part in (0, 1))


def _scaled(t: DataFrame) -> DataFrame:
    rows = _split(t)
    return features.standardised(rows.where("is_test = 0"), rows).select("device_id", "ts", *FEATURES)


def _scored_anomalies(t: DataFrame) -> DataFrame:
    """Battery anomalies whose confidence is that of the isolation forest."""
    rows = forest.confidence(anomaly.prepared(t, DURATIONS), anomaly.SCORED)
    return anomaly.flags(rows, F.col("confidence"))


def queries() -> dict[str, Query]:
    q: dict[str, Callable[[DataFrame], DataFrame]] = {
        # Ingestion
        "json_extract": lambda t: messages.canonical(_messages(t), SALT),
        "pseudonymise": lambda t: t.select(messages.pseudonym(F.col("device_id"), SALT).alias("token")).distinct(),
        # Data quality
        "ping_gaps": lambda t: ts.with_gap(t).select("device_id", "ts", "gap_sec"),
        "dq_overview": quality.overview,
        "dq_null_rates": quality.null_rates,
        "dq_critical_nulls": lambda t: quality.critical_nulls(quality.null_rates(t), above=1.0),
        "dq_exact_dupes": lambda t: quality.exact_duplicates(t.select("device_id", "battery_soc_pct", "gps_lat")),
        "dq_near_dupes": lambda t: quality.near_duplicates(t, DURATIONS.near_duplicate),
        "dq_out_of_range": quality.out_of_range,
        "delayed_devices": lambda t: quality.delayed_devices(t, DURATIONS.delayed),
        "gap_histogram": quality.gap_histogram,
        "imbalance_histogram": quality.imbalance_histogram,
        "figure_pages": quality.figure_pages,
        # Exploration
        "soc_quantiles": eda.soc_quantiles,
        "temp_soc_trend": eda.temperature_trend,
        "corr_matrix": eda.correlation_matrix,
        "soh_delta": eda.soh_delta,
        "soh_series": eda.soh_series,
        "gps_hotspots": eda.hotspots,
        "heat_tiles": eda.heat_tiles,
        "map_center": eda.map_center,
        "map_bounds": eda.map_bounds,
        "top_devices": lambda t: ts.top_devices(t, 5),
        "state_segments": eda.state_segments,
        "state_time_share": lambda t: eda.state_time_share(eda.state_segments(t)),
        # Positions
        "gps_deltas": lambda t: gps.with_deltas(_keyed(t)).select(
            "device_id", "ts", "prev_lat", "prev_lon", "prev_ts", "delta_km_haversine", "delta_sec"
        ),
        "gps_jump": lambda t: _flagged(t).where(gps.FLAGS[0]).select("device_id", "ts", "delta_km_haversine", "delta_sec"),
        "gps_dropout": lambda t: t.where(gps.dropped_out()).select("device_id", "ts"),
        "gps_freeze": lambda t: _flagged(t).where(gps.FLAGS[2]).select("device_id", "ts"),
        "gps_jump_severity": lambda t: gps.jump_severity(_flagged(t), DURATIONS.jump / 1e6),
        "gps_summary": lambda t: gps.summary(_flagged(t)),
        "gps_summary_long": lambda t: gps.summary_long(gps.summary(_flagged(t))),
        "kalman_smooth": lambda t: gps.smooth(t.select("device_id", "ts", "gps_lat", "gps_lon")).select(
            "device_id", "ts", "gps_lat_smooth", "gps_lon_smooth"
        ),
        "kalman_smooth_split": lambda t: gps.smooth(t.select("device_id", "ts", "gps_lat", "gps_lon"), block=WEEK).select(
            "device_id", "ts", "gps_lat_smooth", "gps_lon_smooth"
        ),
        # Trips
        "stop_duration": lambda t: trips.with_stop_sec(t, TRIPS).select("device_id", "ts", "stop_sec"),
        "trip_labels": lambda t: trips.label(t, TRIPS).select("device_id", "ts", "trip_id"),
        "trip_segments": lambda t: trips.segment(t, TRIPS),
        "trip_carbon": lambda t: trips.with_carbon(trips.segment(t, TRIPS)),
        "trip_points_interval_join": lambda t: trips.points_of_trips(t, trips.segment(t, TRIPS)).drop(ts.KEY),
        "trip_track_km": lambda t: _tracks(t).select(
            "device_id", "trip_id", F.size("points").alias("n_points"), trips.track_km(F.col("points")).alias("raw_gps_km")
        ),
        "trip_discrepancy": lambda t: mapmatch.discrepancy(mapmatch.match(_tracks(t), _stub)),
        # As-of, features, splits
        "asof_lag_delta": lambda t: features.with_energy(_keyed(t), DURATIONS).select("device_id", "ts", "soc_delta_5min"),
        "asof_lag_within": lambda t: features.with_energy(_keyed(t), DURATIONS, tolerance=DURATIONS.lag).select(
            "device_id", "ts", "soc_delta_5min"
        ),
        "asof_lead_target": lambda t: _keyed(t).select("device_id", "ts", _ahead().alias(features.TARGET)),
        "energy_features": lambda t: features.with_energy(_keyed(t), DURATIONS).select(
            "device_id", "ts", "discharge_rate_wh", "cell_imbalance"
        ),
        "rolling_features": lambda t: ts.with_rolling(_keyed(t), PLAIN, features.rolling_columns(DURATIONS)).select(
            "device_id", "ts", *[r.name for r in features.rolling_columns(DURATIONS)]
        ),
        "soc_dataset": _soc,
        "time_split": lambda t: features.with_split(t).select("device_id", "ts", "is_test"),
        "cv_folds": lambda t: features.folds(t.select("device_id", "ts")),
        "sequences": lambda t: _sequence_digest(features.sequences(_soc(t))).drop("sequence"),
        "val_split": lambda t: features.with_validation(features.sequences(_soc(t)).drop("sequence").persist(StorageLevel.MEMORY_AND_DISK)),
        "feature_scaling": _scaled,
        "baseline_regression_metrics": lambda t: features.regression_metrics(
            _keyed(t).select("battery_soc_pct", _ahead().alias("ahead")), "ahead", "battery_soc_pct"
        ),
        # Anomalies
        "discharge_spikes": lambda t: anomaly.prepared(t, DURATIONS)
        .where(anomaly.discharge_spike())
        .select("device_id", "ts", "discharge_rate_wh", "discharge_mean_abs"),
        "soh_drop": lambda t: anomaly.prepared(t, DURATIONS)
        .where(anomaly.soh_dropped())
        .select("device_id", "ts", "battery_soh_pct", "soh_max"),
        "bms_anomalies": lambda t: anomaly.flags(anomaly.prepared(t, DURATIONS), F.lit(0.5)),
        "bms_anomalies_scored": _scored_anomalies,
        "isolation_confidence": _forest_confidence,
        "boosted_trees_predictions": _boosted,
        "boosted_trees_grid_predictions": _boosted_grid,
        "boosted_trees_shapley": _shapley,
        "sequence_model_predictions": _sequence_model,
        "sequence_baseline_predictions": _sequence_baseline,
    }
    found = {name: _over(f) for name, f in q.items()}
    found["haversine_nations"] = _haversine_table
    return found


def _haversine_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances on a grid of places, poles and the date line among them."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("double")
    km = haversine_km(key * 7.2 - 90, key * 14.4 - 180, F.lit(0.0), F.lit(0.0))
    return rounded(nation.select("n_nationkey", km.alias("km")))
