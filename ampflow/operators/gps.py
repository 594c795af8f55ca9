"""Position quality: deltas, jumps, dropouts, freezes, summaries, smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.functions.geo import finite, haversine_km
from ampflow.operators.smoothing import kalman_axis, smoothed
from ampflow.operators.timeseries import DEVICE, KEY, PLAIN, TIME, Clock, seconds_between, with_run
from ampflow.schema import SECOND, Kalman

PLACE = ("gps_lat", "gps_lon")
FLAGS = ("gps_anomaly_position_jump", "gps_anomaly_signal_dropout", "gps_anomaly_coordinate_freeze")


def with_deltas(keyed: DataFrame, clock: Clock = PLAIN) -> DataFrame:
    """Adds prev_lat, prev_lon, prev_ts, delta_km_haversine and delta_sec."""
    before = lambda c: F.lag(c).over(clock.window)
    rows = keyed.select(
        "*", before("gps_lat").alias("prev_lat"), before("gps_lon").alias("prev_lon"), before(TIME).alias("prev_ts")
    )
    return rows.select(
        "*",
        haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("gps_lat"), F.col("gps_lon")).alias("delta_km_haversine"),
        seconds_between(F.col(TIME), F.col("prev_ts")).alias("delta_sec"),
    )


def jumped(within: int = 30 * SECOND, km: float = 1.0) -> Column:
    return F.coalesce((F.col("delta_km_haversine") > km) & (F.col("delta_sec") < within / 1e6), F.lit(False))


def dropped_out() -> Column:
    return F.coalesce((F.col("gps_lat") == 0) & (F.col("gps_lon") == 0), F.lit(False))


def detect(df: DataFrame, within: int = 30 * SECOND, least_run: int = 5, clock: Clock = PLAIN) -> DataFrame:
    """The rows with the deltas and the three flags.

    A row is frozen if it moves (over 2 km/h), stands where the row before stood, and at least
    ``least_run`` rows in a sequence did so.
    """
    rows = with_deltas(clock.keyed(df), clock)
    still = (
        finite(F.col("gps_lat"))
        & finite(F.col("gps_lon"))
        & (F.col("gps_lat") == F.col("prev_lat"))
        & (F.col("gps_lon") == F.col("prev_lon"))
        & (F.col("gps_speed_kmh") > 2)
    )
    runs = with_run(rows, F.coalesce(still, F.lit(False)), "__run", clock)
    flags = [jumped(within), dropped_out(), F.col("__run") >= least_run]
    return runs.select("*", *[f.alias(n) for f, n in zip(flags, FLAGS)]).drop(KEY, "__run")


def summary(flagged: DataFrame) -> DataFrame:
    """Counts and rates of the flags for each device."""
    counts = flagged.groupBy(DEVICE).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(f)).alias(f.removeprefix("gps_anomaly_")) for f in FLAGS]
    )
    short = [f.removeprefix("gps_anomaly_") for f in FLAGS]
    return counts.select("*", *[F.round(100.0 * F.col(f) / F.col("n_rows"), 3).alias(f"{f}_rate_pct") for f in short])


def summary_long(summary: DataFrame) -> DataFrame:
    """(device, anomaly, n), for charts."""
    short = [f.removeprefix("gps_anomaly_") for f in FLAGS]
    return summary.unpivot([DEVICE], short, "anomaly", "n")


def jump_severity(flagged: DataFrame, under_sec: float = 60.0) -> DataFrame:
    jump = F.col(FLAGS[0]) & (F.col("delta_sec") > 0) & (F.col("delta_sec") < under_sec)
    return flagged.where(jump).select(DEVICE, TIME, "delta_km_haversine", "delta_sec")


def smooth(
    df: DataFrame, noise: Kalman = Kalman(), mask_dropouts: bool = False, clock: Clock = PLAIN, block: int | None = None
) -> DataFrame:
    """Adds gps_lat_smooth and gps_lon_smooth.

    The filter starts at the device's first row with both coordinates, else at the first of each, else at 0; a window
    finds that place. The recursion has no relational form: Arrow batches of a partition, sorted by device and time, pass
    through it one by one, and the state goes from batch to batch, so a device of any length needs the memory of one batch.
    mask_dropouts: fixes at (0, 0) only predict. block: microseconds; splits long devices over tasks.
    """
    rows = clock.keyed(df)
    own = [c for c in rows.columns if c != KEY]
    hidden = dropped_out() & F.lit(mask_dropouts)
    seen = rows.select("*", *[F.when(finite(F.col(c)) & ~hidden, F.col(c).cast("double")).alias(f"__{c}") for c in PLACE])
    fields = T.StructType([rows.schema[c] for c in own])
    for c in PLACE:
        fields = fields.add(f"{c}_smooth", T.DoubleType())
    if block is not None:
        return smoothed(seen, own, fields, noise, clock, block)
    whole = clock.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(whole)
    both = F.when(F.col("__gps_lat").isNotNull() & F.col("__gps_lon").isNotNull(), F.struct("__gps_lat", "__gps_lon"))
    begun = seen.select("*", first(both).alias("__both"), *[first(f"__{c}").alias(f"__first_{c}") for c in PLACE]).select(
        *rows.columns,
        *[f"__{c}" for c in PLACE],
        *[F.coalesce(F.col("__both")[f"__{c}"], f"__first_{c}", F.lit(0.0)).alias(f"__from_{c}") for c in PLACE],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, state = None, {}
        for batch in batches:
            n = batch.num_rows
            names = batch.column(DEVICE)
            steps = pc.not_equal(names.slice(1), names.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
            edges = [0, *(steps.nonzero()[0] + 1).tolist(), n] if n else [0]
            out = {c: [] for c in PLACE}
            for start, end in zip(edges, edges[1:]):
                if names[start].as_py() != device:
                    device = names[start].as_py()
                    state = {c: (batch.column(f"__from_{c}")[start].as_py(), noise.initial) for c in PLACE}
                for c in PLACE:
                    values = batch.column(f"__{c}").slice(start, end - start).to_pylist()
                    found, *after = kalman_axis(values, *state[c], noise)
                    state[c] = tuple(after)
                    out[c] += found
            smoothed = [pa.array(out[c], pa.float64()) for c in PLACE]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + smoothed, names=fields.names)

    return begun.sortWithinPartitions(DEVICE, KEY).mapInArrow(run, fields)
