"""Trips: stops, boundaries, energy and carbon; windows instead of a state machine.

Under ``TripRules`` a row cannot both start and end a trip. So a row's state follows from the last
boundary before it, and trips number themselves by a running count of the starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.functions.geo import finite, haversine_km
from ampflow.operators.timeseries import DEVICE, KEY, PLAIN, TIME, Clock, seconds_between, with_run
from ampflow.schema import TripRules

GRID_KG_PER_KWH = 0.716
VEHICLE_T_PER_KM = 0.000150
SOC_TO_WH = 10.0


def with_stop_sec(df: DataFrame, rules: TripRules = TripRules(), clock: Clock = PLAIN) -> DataFrame:
    """Adds stop_sec: how long the device has stood, with the whole gap since it last moved; keeps the key."""
    rows = clock.keyed(df)
    elapsed = F.greatest(seconds_between(F.col(TIME), F.lag(TIME).over(clock.window)), F.lit(0.0))
    timed = rows.select("*", F.coalesce(elapsed, F.lit(0.0)).alias("__dt"))
    standing = F.coalesce(F.col("gps_speed_kmh"), F.lit(0.0)) <= rules.stop_speed_kmh
    return with_run(timed, standing, "stop_sec", clock, add=F.col("__dt")).drop("__dt")


def with_trips(df: DataFrame, rules: TripRules = TripRules(), clock: Clock = PLAIN) -> DataFrame:
    """Adds trip_seq, the number of the row's trip in its device, null outside; the ending row belongs to the trip."""
    rows = with_stop_sec(df, rules, clock)
    state, status = F.coalesce("battery_state", F.lit("")), F.coalesce("device_status", F.lit(""))
    begins = (
        finite(F.col("gps_speed_kmh"))
        & (F.col("gps_speed_kmh") > rules.start_speed_kmh)
        & (state == "Discharging")
        & (status == "Active")
    )
    ends = (state == "Charging") | (F.col("stop_sec") >= rules.stop_us / 1e6)
    marked = rows.select("*", F.when(begins, "S").when(ends, "E").alias("__event"))
    back = clock.window.rowsBetween(Window.unboundedPreceding, -1)
    prior = marked.select("*", F.coalesce(F.last("__event", ignorenulls=True).over(back), F.lit("E")).alias("__prior"))
    opens = (F.col("__event") == "S") & (F.col("__prior") == "E")
    inside = F.coalesce((F.col("__event") == "S") | (F.col("__prior") == "S"), F.lit(False))
    running = clock.window.rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.coalesce(opens.cast("long"), F.lit(0))).over(running)
    return prior.select("*", F.when(inside, count).alias("trip_seq")).drop("__prior")


def label(df: DataFrame, rules: TripRules = TripRules(), clock: Clock = PLAIN) -> DataFrame:
    """The rows with trip_id; every start counts, short and unfinished trips too."""
    name = F.when(F.col("trip_seq").isNotNull(), F.concat_ws("_", DEVICE, F.col("trip_seq").cast("string")))
    return with_trips(df, rules, clock).select("*", name.alias("trip_id")).drop(KEY, "__event", "trip_seq", "stop_sec")


def segment(df: DataFrame, rules: TripRules = TripRules(), clock: Clock = PLAIN) -> DataFrame:
    """One row for each finished trip of ``least_km`` or more; their numbers have no holes."""
    rows = with_trips(df, rules, clock).where("trip_seq is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(KEY)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(KEY)))
    edge = lambda pick, c: pick(F.struct(F.col(c).alias("v")), KEY)["v"]  # noqa: E731  a null at the edge stays null
    found = rows.groupBy(DEVICE, "trip_seq").agg(
        F.min(TIME).alias("start_ts"),
        F.max(TIME).alias("end_ts"),
        F.sum(F.coalesce("gps_delta_km", F.lit(0.0))).alias("distance_km"),
        F.avg("gps_speed_kmh").alias("avg_speed_kmh"),
        energy_wh(
            edge(F.min_by, "battery_soc_pct"),
            edge(F.max_by, "battery_soc_pct"),
            F.percentile("battery_usable_ah", 0.5),
            F.percentile("battery_voltage_v", 0.5),
        ).alias("energy_consumed_wh"),
        first("gps_lat").alias("start_lat"),
        first("gps_lon").alias("start_lon"),
        last("gps_lat").alias("end_lat"),
        last("gps_lon").alias("end_lon"),
        F.count_if(F.col("__event") == "E").alias("__ends"),
    )
    kept = found.where((F.col("__ends") > 0) & (F.col("distance_km") >= rules.least_km))
    nth = F.row_number().over(Window.partitionBy(DEVICE).orderBy("trip_seq"))
    return kept.select(
        DEVICE,
        F.concat_ws("_", DEVICE, nth.cast("string")).alias("trip_id"),
        *[c for c in found.columns if c not in (DEVICE, "trip_seq", "__ends")],
    )


def energy_wh(soc_first: Column, soc_last: Column, usable_ah: Column, volts: Column, factor: float = SOC_TO_WH) -> Column:
    """Energy of a drop in charge; null if any part is missing."""
    drop = soc_first - soc_last
    return F.when(drop.isNotNull(), F.greatest(drop, F.lit(0.0))) * usable_ah * volts * factor


def net_tco2e(energy: Column, km: Column) -> Column:
    return energy / 1000 * GRID_KG_PER_KWH - km * VEHICLE_T_PER_KM


def with_carbon(trips: DataFrame) -> DataFrame:
    return trips.withColumn("net_tco2e", net_tco2e(F.col("energy_consumed_wh"), F.col("distance_km")))


def points_of_trips(df: DataFrame, trips: DataFrame, clock: Clock = PLAIN, bucket_us: int = 86400 * 1_000_000) -> DataFrame:
    """(device, trip_id, key, lat, lon) of the rows between a trip's start and end.

    Both sides are dealt by device and day, so a device of any length spreads, and neither side
    needs to fit anywhere; a trip stands in each day that it touches.
    """
    points = clock.keyed(df).select(DEVICE, TIME, KEY, "gps_lat", "gps_lon", F.floor(F.unix_micros(TIME) / bucket_us).alias("__day"))
    day = lambda c: F.floor(F.unix_micros(c) / bucket_us)
    spans = trips.select(
        F.col(DEVICE).alias("__device"), "trip_id", "start_ts", "end_ts",
        F.explode(F.sequence(day("start_ts"), day("end_ts"))).alias("__trip_day"),
    )
    met = points.join(
        spans,
        (F.col(DEVICE) == F.col("__device"))
        & (F.col("__day") == F.col("__trip_day"))
        & F.col(TIME).between(F.col("start_ts"), F.col("end_ts")),
    )
    return met.select(DEVICE, "trip_id", TIME, KEY, "gps_lat", "gps_lon")


def tracks(points: DataFrame, most: int = 50) -> DataFrame:
    """(device, trip_id, points): positions in order, without nulls and repeats, thinned to ``most`` at even steps."""
    placed = points.where("gps_lat is not null and gps_lon is not null")
    order = Window.partitionBy(DEVICE, "trip_id").orderBy(KEY)
    place = F.struct(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    moved = placed.select(DEVICE, "trip_id", KEY, place.alias("p")).withColumn("__before", F.lag("p").over(order))
    changed = moved.where(F.col("__before").isNull() | (F.col("p") != F.col("__before")))
    whole = Window.partitionBy(DEVICE, "trip_id")
    numbered = changed.select(
        "*", (F.row_number().over(order) - 1).alias("__i"), F.count("*").over(whole).alias("__n")
    )
    # Row i stays if it is the rounded place (half to even) of some step j; j is i's own share, rounded.
    last = F.col("__n") - 1
    j = F.round(F.col("__i") * (most - 1) / last)
    stays = lambda j: F.rint(j * last / (most - 1)) == F.col("__i")
    thinned = numbered.where((F.col("__n") <= most) | stays(j) | stays(j - 1) | stays(j + 1))
    listed = thinned.groupBy(DEVICE, "trip_id").agg(F.sort_array(F.collect_list(F.struct(F.col("__i"), "p"))).alias("__l"))
    return listed.select(DEVICE, "trip_id", F.transform("__l", lambda x: x["p"]).alias("points"))


def track_km(points: Column) -> Column:
    """The length of a list of positions; 0 for fewer than two."""
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points), F.lit(1))),
        lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
