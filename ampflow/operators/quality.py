"""Data-quality measures: nulls, duplicates, ranges, gaps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.operators.quantiles import exact_quantiles
from ampflow.operators.timeseries import DEVICE, PLAIN, TIME, Clock, seconds_between, with_gap
from ampflow.schema import COLUMNS, CRITICAL_COLUMNS, CRITICAL_NULL_PCT, MINUTE, SECOND


def checks() -> dict[str, Column]:
    c = F.col
    outside = lambda name, low, high: (c(name) < low) | (c(name) > high)
    return {
        "soc_out_of_range": outside("battery_soc_pct", 0, 100),
        "soh_out_of_range": outside("battery_soh_pct", 0, 100),
        "cell_voltage_out_of_range": (c("cell_voltage_min") < 2.5) | (c("cell_voltage_max") > 4.2),
        "lat_out_of_range": outside("gps_lat", -90, 90),
        "lon_out_of_range": outside("gps_lon", -180, 180),
        "negative_speed": c("gps_speed_kmh") < 0,
        "negative_delta": c("gps_delta_km") < 0,
        "negative_total": c("gps_total_km") < 0,
        "pack_voltage_not_positive": c("battery_voltage_v") <= 0,
    }


def cell_imbalance() -> Column:
    return F.col("cell_voltage_max") - F.col("cell_voltage_min")


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(DEVICE).alias("n_devices"))


def null_rates(df: DataFrame, clock: Clock = PLAIN) -> DataFrame:
    """(column, null_pct) of all canonical columns, the gap and the imbalance, in one pass over the windowed rows.

    Rows without a device or time have no gap; they count as null there.
    """
    gaps = with_gap(df, clock).agg(F.count("gap_sec").alias("n")).select("n").scalar()
    names = [*COLUMNS, "cell_imbalance"]
    rows = df.select(*COLUMNS, cell_imbalance().alias("cell_imbalance"))
    counts = rows.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in names]).select("*", gaps.alias("gap_sec"))
    pct = lambda c: F.round(100.0 * F.try_divide(F.col("__all") - F.col(c), F.col("__all")), 2)
    pairs = [F.struct(F.lit(c).alias("column"), pct(c).alias("null_pct")) for c in [*names, "gap_sec"]]
    return counts.select(F.inline(F.array(*pairs)))


def critical_nulls(rates: DataFrame, above: float = CRITICAL_NULL_PCT) -> DataFrame:
    return rates.where(F.col("column").isin(*CRITICAL_COLUMNS) & (F.col("null_pct") > above))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal."""
    return df.groupBy(*df.columns).agg((F.count("*") - 1).alias("more")).agg(
        F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("n_exact_duplicates")
    )


def near_duplicates(df: DataFrame, within: int = SECOND, clock: Clock = PLAIN) -> DataFrame:
    return with_gap(df, clock).agg(F.count_if(F.col("gap_sec") <= within / 1e6).alias("n_near_duplicates"))


def out_of_range(df: DataFrame) -> DataFrame:
    """(check, n_rows) of every range check, in one pass."""
    every = checks()
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in every.items()])
    pairs = [F.struct(F.lit(name).alias("check"), F.col(name).alias("n_rows")) for name in every]
    return counted.select(F.inline(F.array(*pairs)))


def delayed_devices(df: DataFrame, over: int = MINUTE, share: float = 0.1) -> DataFrame:
    """Devices of whose rows more than a share came late after the one before; rows without a time are rows, but never late."""
    before = F.lag(TIME).over(Window.partitionBy(DEVICE).orderBy(TIME))
    rows = df.where(F.col(DEVICE).isNotNull()).select(DEVICE, seconds_between(F.col(TIME), before).alias("gap_sec"))
    counted = rows.groupBy(DEVICE).agg(F.count("*").alias("n_rows"), F.count_if(F.col("gap_sec") > over / 1e6).alias("n_delayed"))
    return counted.withColumn("delayed_ratio", F.col("n_delayed") / F.col("n_rows")).where(F.col("delayed_ratio") > share)


def _histogram(values: DataFrame, groups: list[str], bins: int, floor: float) -> DataFrame:
    """Equal bins between the smallest and largest value up to the 99th percentile (or ``floor`` if that is more).

    The last bin holds its right edge. Each group's values are aggregated to distinct values first,
    so the percentile sees a value once, with its count; that of the whole table is searched for in bounded memory.
    """
    counts = values.where("v is not null").groupBy(*groups, "v").agg(F.count("*").alias("n"))
    if groups:
        limits = counts.groupBy(*groups).agg(F.greatest(F.percentile("v", 0.99, F.col("n")), F.lit(floor)).alias("cap"))
        inside = _with(counts, limits, groups).where("v <= cap")
    else:
        cap = exact_quantiles(values, {"v": F.col("v")}, (0.99,))["v"][0]
        inside = counts.select("*", F.lit(max(cap or floor, floor)).alias("cap")).where("v <= cap")
    edges = inside.groupBy(*groups).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    binned = _with(inside.drop("cap"), edges, groups)
    width = F.col("high") - F.col("low")
    position = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width * bins)).otherwise(bins // 2)
    return (
        binned.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(*groups, "bin")
        .agg(F.sum("n").cast("long").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
    )


def _with(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Joins what each group has; without groups, the one row of the whole."""
    if groups:
        return left.join(right, groups)
    return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])


def gap_histogram(df: DataFrame, bins: int = 40, clock: Clock = PLAIN) -> DataFrame:
    """(device, bin, n, low, high) of the gaps between a device's rows."""
    gaps = with_gap(df, clock).select(DEVICE, F.col("gap_sec").alias("v"))
    return _histogram(gaps, [DEVICE], bins, 1.0)


def imbalance_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n, low, high) of the cells' imbalance."""
    return _histogram(df.select(cell_imbalance().alias("v")), [], bins, 0.01)


def figure_pages(df: DataFrame, each: int = 9) -> DataFrame:
    """(device, n, page): devices by number of rows, so many on a page."""
    counts = df.where(F.col(DEVICE).isNotNull()).groupBy(DEVICE).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.desc("n"), DEVICE)) - 1
    return counts.select(DEVICE, "n", F.floor(nth / each).cast("int").alias("page"))
