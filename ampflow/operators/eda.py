"""Exploratory aggregates: what the charts and maps show, as small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.operators.timeseries import DEVICE, PLAIN, TIME, Clock, islands, seconds_between, top_devices
from ampflow.schema import BATTERY_FIELDS, GPS_FIELDS

BATTERY = tuple(c for c in BATTERY_FIELDS if c != "battery_state")
GPS = tuple(GPS_FIELDS)


def soc_quantiles(df: DataFrame) -> DataFrame:
    """Exact quartiles of the charge for each battery state."""
    parts = F.percentile("battery_soc_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.where("battery_soc_pct is not null").groupBy("battery_state").agg(F.count("*").alias("n"), parts.alias("__q"))
    return found.select("battery_state", "n", *[F.col("__q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)])


def temperature_trend(df: DataFrame) -> DataFrame:
    """The least-squares line of temperature over charge."""
    y, x = F.col("battery_temp_c"), F.col("battery_soc_pct")
    return df.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def correlation(a: str, b: str) -> Column:
    """Pearson's on the rows that have both; null for a constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, rows: tuple[str, ...] = BATTERY, columns: tuple[str, ...] = GPS) -> DataFrame:
    """(battery_column, gps_column, corr) of all pairs: each row gives one small row a pair, which tasks aggregate at once."""
    pairs = list(enumerate((a, b) for a in rows for b in columns))
    cells = [F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in pairs]
    spread = df.select(F.inline(F.array(*cells))).where("x is not null and y is not null")
    found = spread.groupBy("pair").agg(correlation("x", "y").alias("corr"))
    names = [F.struct(F.lit(i).alias("pair"), F.lit(a).alias("battery_column"), F.lit(b).alias("gps_column")) for i, (a, b) in pairs]
    every = df.sparkSession.range(1).select(F.inline(F.array(*names)))
    return every.join(found, "pair", "left").select("battery_column", "gps_column", "corr")


def soh_delta(df: DataFrame) -> DataFrame:
    """(device, soh_first, soh_last, soh_delta): the change of health; null for devices with fewer than two values."""
    known = df.where(F.col(TIME).isNotNull() & F.col("battery_soh_pct").isNotNull())
    found = known.groupBy(DEVICE).agg(
        F.min_by("battery_soh_pct", TIME).alias("soh_first"),
        F.max_by("battery_soh_pct", TIME).alias("soh_last"),
        F.count("*").alias("n"),
    )
    return found.select(
        DEVICE, "soh_first", "soh_last", F.when(F.col("n") >= 2, F.col("soh_last") - F.col("soh_first")).alias("soh_delta")
    )


def soh_series(df: DataFrame, k: int = 5) -> DataFrame:
    """(device, ts, battery_soh_pct) of the devices with most rows, for the chart."""
    return df.join(F.broadcast(top_devices(df, k).select(DEVICE)), DEVICE, "left_semi").select(DEVICE, TIME, "battery_soh_pct")


def located(df: DataFrame) -> DataFrame:
    """Rows with a fix of which neither coordinate is zero."""
    return df.where("gps_lat is not null and gps_lon is not null and gps_lat <> 0 and gps_lon <> 0")


def hotspots(df: DataFrame, k: int = 3) -> DataFrame:
    """The busiest cells of a grid of hundredths of a degree; ties go to the smaller coordinates."""
    cell = lambda c: F.bround(c, 2)
    cells = located(df).groupBy(cell("gps_lat").alias("lat_r"), cell("gps_lon").alias("lon_r")).agg(F.count("*").alias("n"))
    return cells.orderBy(F.desc("n"), "lat_r", "lon_r").limit(k)


def heat_tiles(df: DataFrame, levels: int = 5) -> DataFrame:
    """(level, size, south, west, n): a pyramid of tiles over all located rows, for a heat map at any zoom.

    Level 0 has tiles of a hundredth of a degree; each further level has tiles ten times as wide. The rows are counted once, at level 0; the
    others add those counts up. So the result is bounded by the tiles, whatever the number of rows.
    """
    inside = located(df).where("gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180")
    cell = lambda c: F.floor(F.col(c) * 100).alias(c)
    finest = inside.groupBy(cell("gps_lat"), cell("gps_lon")).agg(F.count("*").alias("n"))
    tiles = [F.struct(F.lit(k).alias("level"), *[F.floor(F.col(c) / 10**k).alias(c[-3:]) for c in ("gps_lat", "gps_lon")]) for k in range(levels)]
    counted = finest.select(F.explode(F.array(*tiles)).alias("t"), "n").groupBy("t.level", "t.lat", "t.lon").agg(F.sum("n").alias("n"))
    size = F.pow(F.lit(10.0), F.col("level") - 2)
    return counted.select("level", size.alias("size"), (F.col("lat") * size).alias("south"), (F.col("lon") * size).alias("west"), "n")


def map_center(df: DataFrame, k: int = 2) -> DataFrame:
    """The centres of the heat map (means) and of the map of the busiest devices (medians), with the default place.

    Where the busiest devices have no median, that of their smoothed positions counts, if the rows have them.
    """
    heat = located(df).agg(F.avg("gps_lat").alias("heat_lat"), F.avg("gps_lon").alias("heat_lon"))
    devices = top_devices(df, k, F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).select(DEVICE)
    chosen = df.join(F.broadcast(devices), DEVICE, "left_semi")
    median = lambda c: [F.percentile(name, 0.5) for name in (c, f"{c}_smooth") if name in df.columns]
    middle = chosen.agg(F.coalesce(*median("gps_lat")).alias("lat"), F.coalesce(*median("gps_lon")).alias("lon"))
    place = lambda c, default: F.coalesce(c, F.lit(default))
    return heat.select(
        place("heat_lat", 20.0).alias("heat_lat"),
        place("heat_lon", 78.0).alias("heat_lon"),
        place(middle.select("lat").scalar(), 20.0).alias("map_lat"),
        place(middle.select("lon").scalar(), 78.0).alias("map_lon"),
    )


def map_bounds(df: DataFrame) -> DataFrame:
    both = df.where("gps_lat is not null and gps_lon is not null")
    return both.agg(
        F.min("gps_lat").alias("south"), F.min("gps_lon").alias("west"), F.max("gps_lat").alias("north"), F.max("gps_lon").alias("east")
    )


def operating_state() -> Column:
    """Charging whatever the status; a missing status is Inactive."""
    return F.when(F.col("battery_state") == "Charging", "Charging").otherwise(F.coalesce("device_status", F.lit("Inactive")))


def state_segments(df: DataFrame, clock: Clock = PLAIN) -> DataFrame:
    """(device, segment, state, start_ts, end_ts, n): runs of rows in one operating state."""
    return islands(clock.keyed(df), operating_state(), clock)


def state_time_share(segments: DataFrame) -> DataFrame:
    """(device, state, share_pct): each state's part of the time inside segments; null where a device has none."""
    spans = segments.groupBy(DEVICE, "state").agg(
        F.sum(F.greatest(seconds_between(F.col("end_ts"), F.col("start_ts")), F.lit(0.0))).alias("sec")
    )
    whole = F.sum("sec").over(Window.partitionBy(DEVICE))
    return spans.select(DEVICE, "state", (100.0 * F.try_divide(F.col("sec"), whole)).alias("share_pct"))
