"""Matching trips to roads: an injected matcher, and how far its route is from the raw track."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.operators.timeseries import PLAIN, Clock
from ampflow.operators.trips import points_of_trips, track_km, tracks

#: (points) -> (route km or None, confidence, status)
Matcher = Callable[[list[tuple[float, float]]], tuple[float | None, float, str]]
#: After an answer that asks for fewer points, these are tried in turn.
SMALLER = (50, 40, 30, 25, 20, 15)
RETRY = ("http_400", "http_414", "http_429")

ANSWERS = "digest string, matched_route_km double, match_confidence double, match_status string, settled boolean, asked timestamp"
NAMES = [field.split()[0] for field in ANSWERS.split(", ")]
#: Beginnings of the statuses that another run may better.
PASSING = ("request_error", "http_429", "http_5")

MATCHED = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("trip_id", T.StringType()),
        T.StructField("raw_gps_km", T.DoubleType()),
        T.StructField("matched_route_km", T.DoubleType()),
        T.StructField("match_confidence", T.DoubleType()),
        T.StructField("match_status", T.StringType()),
    ]
)


def thinned(points: list, most: int) -> list:
    """At most so many points at even steps, the first and last included."""
    if len(points) <= most:
        return points
    return [points[round(i * (len(points) - 1) / (most - 1))] for i in range(most)]


def http_matcher(url: str, profile: str = "driving", timeout: float = 10.0) -> Matcher:
    """A matcher that asks a routing service of the match/v1 kind."""

    def match(points: list[tuple[float, float]]) -> tuple[float | None, float, str]:
        path = ";".join(f"{lon:.6f},{lat:.6f}" for lat, lon in points)
        try:
            with urllib.request.urlopen(f"{url}/match/v1/{profile}/{path}?overview=false", timeout=timeout) as answer:
                answered = json.load(answer)
        except urllib.error.HTTPError as e:
            return None, 0.0, f"http_{e.code}:{e.read(200).decode(errors='replace')}"
        except Exception as e:  # a row of the result, not the end of the job
            return None, 0.0, f"request_error:{type(e).__name__}"
        if not isinstance(answered, dict) or answered.get("code") != "Ok":
            return None, 0.0, f"osrm_{answered.get('code') if isinstance(answered, dict) else 'invalid_json'}"
        first = next(iter(answered.get("matchings") or []), None)
        if first is None:
            return None, 0.0, "no_matchings"
        km, sure = first.get("distance"), float(first.get("confidence") or 0.0)
        return (float(km) / 1000, sure, "ok") if km is not None else (None, sure, "missing_distance")

    return match


def answered(matcher: Matcher, places: list[tuple[float, float]], pace: Callable[[], None] = lambda: None) -> tuple[float | None, float, str]:
    """The matcher's answer to a track, asked again with fewer points where it wants that; pace runs before each request."""
    found = (None, 0.0, "too_few_points")
    for most in SMALLER if len(places) >= 2 else ():
        pace()
        found = matcher(thinned(places, most))
        if not found[2].startswith(RETRY):
            break
    return found


def match(tracks: DataFrame, matcher: Matcher, pause: float = 0.0) -> DataFrame:
    """(device_id, trip_id, raw_gps_km, matched_route_km, match_confidence, match_status) of every track.

    tracks: (device_id, trip_id, points). Requests run where the rows are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for device, trip, km, points in zip(*(batch[c] for c in ("device_id", "trip_id", "raw_gps_km", "points"))):
                found = answered(matcher, [(p["lat"], p["lon"]) for p in points], lambda: time.sleep(pause))
                out.append((device, trip, km, *found))
            yield pd.DataFrame(out, columns=MATCHED.names).astype({"matched_route_km": float})

    return tracks.withColumn("raw_gps_km", track_km(F.col("points"))).mapInPandas(run, MATCHED)


@dataclass(frozen=True)
class Ledger:
    """A folder of the answers of one service, and how it is asked.

    path: a shared folder. Answers are kept under a digest of the track as the service reads it (six decimals), so equal
    tracks are asked once, in whatever trip or run. parts: the unanswered tracks go in so many jobs by their digest, each of which commits
    its answers at its end. A run that is killed asks only the tracks of the part it was in again; a lost task asks
    its own again. askers tasks ask at a time; per_second bounds the requests of all of them together.
    """

    path: str
    parts: int = 20
    askers: int = 4
    per_second: float | None = None

    def answers(self, spark: SparkSession) -> DataFrame:
        """(digest, matched_route_km, match_confidence, match_status, settled, asked): all answers so far."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/answers")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(ANSWERS).parquet(f"{self.path}/answers") if there else spark.createDataFrame([], ANSWERS)


def digest(points: Column) -> Column:
    """A track's name: a hash of its places to six decimals, in their order."""
    place = lambda p: F.format_string("%.6f,%.6f", p["lat"].cast("double"), p["lon"].cast("double"))
    return F.sha2(F.concat_ws(";", F.transform(points, place)), 256)


def match_once(tracks: DataFrame, matcher: Matcher, ledger: Ledger) -> DataFrame:
    """As ``match``, by way of the ledger: only tracks without a settled answer are asked, each once.

    Failures of the service (``PASSING``) are written as well, so that the result shows them, and asked again by the next run. The tracks
    should be stored: they are read for each part. A track of fewer than two points is never asked.
    """
    spark = tracks.sparkSession
    named = tracks.select("device_id", "trip_id", track_km(F.col("points")).alias("raw_gps_km"), "points", digest(F.col("points")).alias("digest"))
    part = F.pmod(F.xxhash64("digest"), F.lit(ledger.parts))
    interval = ledger.askers / ledger.per_second if ledger.per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = time.monotonic()

        def pace() -> None:
            nonlocal free
            time.sleep(max(0.0, free - time.monotonic()))
            free = time.monotonic() + interval

        for batch in batches:
            for name, points in zip(batch["digest"], batch["points"]):
                km, sure, status = answered(matcher, [(p["lat"], p["lon"]) for p in points], pace)
                row = (name, km, sure, status, not status.startswith(PASSING), pd.Timestamp.now("UTC"))
                yield pd.DataFrame([row], columns=NAMES).astype({"matched_route_km": float})

    for n in range(ledger.parts):
        settled = ledger.answers(spark).where("settled").where(part == n).select("digest")
        wanted = named.where(part == n).where(F.size("points") >= 2).groupBy("digest").agg(F.min("points").alias("points"))
        open_ones = wanted.join(settled, "digest", "left_anti").repartition(ledger.askers)
        open_ones.mapInPandas(run, ANSWERS).write.mode("append").parquet(f"{ledger.path}/answers")
    latest = ledger.answers(spark).groupBy("digest").agg(
        F.max_by(F.struct("matched_route_km", "match_confidence", "match_status"), F.struct("settled", "asked")).alias("a")
    )
    met = named.join(latest, "digest", "left")
    return met.select(
        "device_id",
        "trip_id",
        "raw_gps_km",
        F.col("a.matched_route_km").alias("matched_route_km"),
        F.coalesce("a.match_confidence", F.lit(0.0)).alias("match_confidence"),
        F.coalesce("a.match_status", F.lit("too_few_points")).alias("match_status"),
    )


def match_trips(
    rows: DataFrame, trips: DataFrame, matcher: Matcher, most: int = 50, clock: Clock = PLAIN, ledger: Ledger | None = None
) -> DataFrame:
    """The discrepancy of every trip, one row each; the smoothed positions count if the rows have them.

    With a ledger, tracks answered before are not asked again. A trip without a position has an empty track: 0 km and ``too_few_points``.
    """
    if "gps_lat_smooth" in rows.columns:
        rows = rows.drop("gps_lat", "gps_lon").withColumnsRenamed({"gps_lat_smooth": "gps_lat", "gps_lon_smooth": "gps_lon"})
    found = tracks(points_of_trips(rows, trips, clock), most)
    none = F.array().cast(found.schema["points"].dataType)
    every = trips.select("device_id", "trip_id").join(found, ["device_id", "trip_id"], "left")
    asked = every.select("device_id", "trip_id", F.coalesce("points", none).alias("points"))
    if ledger is None:
        return discrepancy(match(asked, matcher))
    asked.write.mode("overwrite").parquet(f"{ledger.path}/tracks")
    return discrepancy(match_once(rows.sparkSession.read.parquet(f"{ledger.path}/tracks"), matcher, ledger))


def discrepancy(matched: DataFrame) -> DataFrame:
    """Adds discrepancy_km and discrepancy_pct and rounds as the report does."""
    raw, route = F.col("raw_gps_km"), F.col("matched_route_km")
    off = route - raw
    return matched.select(
        "device_id",
        "trip_id",
        F.round(raw, 4).alias("raw_gps_km"),
        F.round(route, 4).alias("matched_route_km"),
        F.round(off, 4).alias("discrepancy_km"),
        F.round(F.when(raw > 1e-6, off / raw * 100), 2).alias("discrepancy_pct"),
        F.round("match_confidence", 4).alias("match_confidence"),
        "match_status",
    )
