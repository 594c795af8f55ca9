"""The jobs from raw messages to reports, models and trips; each writes what it finds under one folder.

``python -m ampflow.jobs quality|soc|positions|all --raw PATH --out PATH --salt SALT [--matcher URL]``
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ampflow.operators import anomaly, attribution, eda, features, forest, gps, mapmatch, models, quality, recurrent, trips
from ampflow.operators.timeseries import DEVICE, TIME, Clock, top_devices
from ampflow.schema import COLUMNS, Durations, TripRules
from ampflow.session import session, ship
from ampflow.sources import messages, sinks

#: Pings of a device at one time stay in the order in which they came in.
INGESTED = Clock(tie=(messages.INGEST_SEQ,))


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet, and read from there by what follows."""
    sinks.write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def _frames(frames: dict[str, DataFrame], out: str) -> None:
    for name, df in frames.items():
        sinks.write_parquet(df, f"{out}/{name}")


def ingest(spark: SparkSession, raw: str, out: str, salt: str) -> DataFrame:
    """The canonical rows with their order of ingestion, as Parquet and CSV, and how many messages had no identifier."""
    counts = Observation("ingestion")
    seq = messages.INGEST_SEQ
    read = messages.numbered(messages.read_messages(spark, raw))
    rows = _stored(messages.canonical(read, salt, keep=(seq,), counts=counts), f"{out}/telemetry")
    sinks.write_text(spark, models.metrics_json(counts.get), f"{out}/ingestion")
    sinks.write_csv(rows.select(*COLUMNS), f"{out}/telemetry_csv")
    return rows


def quality_report(telemetry: DataFrame, out: str, durations: Durations = Durations()) -> None:
    """The data-quality report as a page, and the frames of its charts and of the exploration as Parquet."""
    rows = telemetry.select(*COLUMNS)
    rates = quality.null_rates(rows)
    parts = {
        "Records and devices": quality.overview(rows),
        "Null rates (%)": rates,
        "Signal columns with many nulls": quality.critical_nulls(rates),
        "Exact duplicates": quality.exact_duplicates(rows),
        "Near duplicates": quality.near_duplicates(rows, durations.near_duplicate),
        "Out of range": quality.out_of_range(rows),
        "Devices with delayed pings": quality.delayed_devices(rows, durations.delayed).orderBy(F.desc("delayed_ratio"), DEVICE),
        "Gaps between pings": quality.gap_histogram(rows).orderBy(DEVICE, "bin"),
        "Cell imbalance (V)": quality.imbalance_histogram(rows).orderBy("bin"),
    }
    sinks.write_text(telemetry.sparkSession, sinks.html_report("Telemetry data quality", parts), f"{out}/quality_report")
    segments = _stored(eda.state_segments(telemetry, INGESTED), f"{out}/charts/state_segments")
    _frames(
        {
            "gap_histogram": parts["Gaps between pings"],
            "imbalance_histogram": parts["Cell imbalance (V)"],
            "figure_pages": quality.figure_pages(rows),
            "soc_quantiles": eda.soc_quantiles(rows),
            "temperature_trend": eda.temperature_trend(rows),
            "correlations": eda.correlation_matrix(rows),
            "soh_delta": eda.soh_delta(rows),
            "soh_series": eda.soh_series(rows),
            "hotspots": eda.hotspots(rows),
            "heat_map": eda.heat_tiles(rows),
            "state_time_share": eda.state_time_share(segments),
        },
        f"{out}/charts",
    )


def soc_models(
    telemetry: DataFrame,
    out: str,
    grid: dict[str, tuple] = models.GRID,
    durations: Durations = Durations(),
    settings: recurrent.Settings = recurrent.Settings(),
) -> DataFrame:
    """Features, both models with their metrics, and anomaly flags; returns the comparison of the models."""
    spark = telemetry.sparkSession
    dataset = features.with_split(features.soc_dataset(telemetry, durations, INGESTED))
    rows = _stored(dataset, f"{out}/soc_features")
    sinks.write_csv(rows.drop(messages.INGEST_SEQ), f"{out}/soc_features_csv")
    train, test = rows.where("is_test = 0"), rows.where("is_test = 1")

    trained = models.train_trees(train, grid, clock=INGESTED)
    models.save(trained.model, f"{out}/models/boosted_trees")
    tree = models.evaluate(trained.model, models.with_missing(test)) | {"training_sec": trained.seconds}
    sinks.write_text(
        spark, models.metrics_json(tree | {"cv_mse": trained.cv_mse, "settings": trained.settings}), f"{out}/boosted_trees_metrics"
    )
    weights = spark.createDataFrame(models.importances(trained.model), "feature string, importance double")
    sinks.write_csv(weights.coalesce(1).orderBy(F.desc("importance"), "feature"), f"{out}/importances")

    shown = attribution.sample(test, (DEVICE, TIME, messages.INGEST_SEQ))
    sinks.write_csv(attribution.summary(trained.model, shown).coalesce(1).orderBy(F.desc("mean_abs_shap"), "feature"), f"{out}/shapley_summary")

    began = time.monotonic()
    listed = lambda part: features.sequences(features.standardised(train, part), clock=INGESTED)
    model = recurrent.train(features.with_validation(listed(train)), features.TARGET, settings)
    taken = time.monotonic() - began
    model.save(spark, f"{out}/models/sequences")
    sequence = models.evaluate(model, listed(test)) | {"training_sec": taken, "epochs": len(model.errors)}
    sinks.write_text(spark, models.metrics_json(sequence), f"{out}/sequence_metrics")
    compared = models.comparison(spark, tree, sequence)
    sinks.write_csv(compared.coalesce(1), f"{out}/model_comparison")

    scored = forest.confidence(anomaly.prepared(telemetry, durations, INGESTED), anomaly.SCORED)
    found = anomaly.flags(scored, F.col("confidence"))
    sinks.write_csv(found.orderBy(DEVICE, TIME, "anomaly_type"), f"{out}/anomaly_flags")
    return compared


def positions(
    telemetry: DataFrame,
    out: str,
    matcher: mapmatch.Matcher | None = None,
    durations: Durations = Durations(),
    rules: TripRules = TripRules(),
    ledger: mapmatch.Ledger | None = None,
) -> DataFrame:
    """Position flags and smoothed tracks, their report and map frames, trips with carbon and, given a matcher, their routes.

    ledger: where the matcher's answers are kept for later runs.
    """
    spark = telemetry.sparkSession
    flagged = gps.detect(telemetry, durations.jump, clock=INGESTED)
    rows = _stored(gps.smooth(flagged, clock=INGESTED), f"{out}/positions")
    summary = _stored(gps.summary(rows), f"{out}/charts/gps_summary")
    severity = _stored(gps.jump_severity(rows), f"{out}/charts/jump_severity")
    parts = {
        "Records and devices": quality.overview(rows),
        "Anomalies of each device": summary.orderBy(F.desc("n_rows"), DEVICE),
        "Position jumps": severity.orderBy(F.desc("delta_km_haversine"), DEVICE, TIME),
    }
    sinks.write_text(spark, sinks.html_report("Position quality", parts), f"{out}/gps_report")
    busy = top_devices(rows, 2, F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).select(DEVICE)
    _frames(
        {
            "gps_summary_long": gps.summary_long(summary),
            "map_center": eda.map_center(rows),
            "map_bounds": eda.map_bounds(rows),
            "map_tracks": rows.join(F.broadcast(busy), DEVICE, "left_semi").select(
                DEVICE, TIME, *gps.PLACE, *[f"{c}_smooth" for c in gps.PLACE]
            ),
        },
        f"{out}/charts",
    )
    segments = _stored(trips.segment(rows, rules, INGESTED), f"{out}/trips")
    sinks.write_csv(segments.orderBy(DEVICE, "start_ts"), f"{out}/trip_segments")
    sinks.write_csv(trips.with_carbon(segments).orderBy(DEVICE, "start_ts"), f"{out}/trip_carbon_credits")
    if matcher is not None:
        sinks.write_csv(mapmatch.match_trips(rows, segments, matcher, clock=INGESTED, ledger=ledger), f"{out}/trip_route_matching")
    return segments


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ampflow.jobs")
    parser.add_argument("job", choices=["quality", "soc", "positions", "all"])
    for name in ("raw", "out", "salt"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--matcher", help="address of a routing service; without it no trip is matched")
    parser.add_argument("--ledger", help="folder of the routing service's answers, kept for later runs")
    chosen = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    telemetry = ingest(spark, chosen.raw, chosen.out, chosen.salt)
    if chosen.job in ("quality", "all"):
        quality_report(telemetry, chosen.out)
    if chosen.job in ("soc", "all"):
        soc_models(telemetry, chosen.out)
    if chosen.job in ("positions", "all"):
        positions(
            telemetry,
            chosen.out,
            mapmatch.http_matcher(chosen.matcher) if chosen.matcher else None,
            ledger=mapmatch.Ledger(chosen.ledger) if chosen.ledger else None,
        )


if __name__ == "__main__":
    main()
