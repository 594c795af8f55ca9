"""Features and target of the state-of-charge model, splits, folds and sequences."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.operators.quality import cell_imbalance
from ampflow.operators.quantiles import exact_quantiles
from ampflow.operators.timeseries import DEVICE, OWN, PART, PLAIN, TIME, Clock, Rolling, asof, dealt, gathered, spread, with_rolling
from ampflow.schema import FEATURES, Durations

REQUIRED = (
    DEVICE, TIME, "battery_soc_pct", "battery_usable_ah", "battery_voltage_v", "battery_temp_c", "battery_soh_pct",
    "capacity_charge_ah", "gps_speed_kmh", "cell_voltage_min", "cell_voltage_max",
)
TARGET = "target_soc_t_plus_10min"


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_energy(keyed: DataFrame, durations: Durations = Durations(), clock: Clock = PLAIN, tolerance: int | None = None) -> DataFrame:
    """Adds soc_delta_5min, discharge_rate_wh and cell_imbalance to rows that have their key."""
    lagged = asof("battery_soc_pct", clock.until(durations.lag), durations.lag, tolerance)
    rows = keyed.select("*", (F.col("battery_soc_pct") - lagged).alias("soc_delta_5min"), cell_imbalance().alias("cell_imbalance"))
    rate = F.col("soc_delta_5min") * F.col("battery_usable_ah") * F.col("battery_voltage_v") * 10.0
    return rows.select("*", rate.alias("discharge_rate_wh"))


def rolling_columns(durations: Durations = Durations()) -> list[Rolling]:
    c, d = F.col, durations
    return [
        Rolling("rolling_temp_mean_7d", c("battery_temp_c"), "avg", d.long, 10),
        Rolling("rolling_soc_std_1h", c("battery_soc_pct"), "std", d.medium, 10),
        Rolling("rolling_speed_mean_5min", c("gps_speed_kmh"), "avg", d.short, 3),
        Rolling("rolling_temp_std_1h", c("battery_temp_c"), "std", d.medium, 10),
        Rolling("rolling_voltage_std_1h", c("battery_voltage_v"), "std", d.medium, 10),
        Rolling("rolling_imbalance_mean_5min", cell_imbalance(), "avg", d.short, 3),
    ]


def soc_dataset(
    df: DataFrame, durations: Durations = Durations(), clock: Clock = PLAIN, tolerance: int | None = None, block: int | None = None
) -> DataFrame:
    """(device, ts, features, target, and what orders ties): one row for each ping with a target.

    block: microseconds; splits long devices over tasks (``timeseries.spread``). The number of tasks grows with the rows (``timeseries.dealt``).
    """
    require(df)
    needed, n = df.select(*dict.fromkeys([*REQUIRED, *clock.tie])), df.count()
    keyed = clock.keyed(needed if block is not None else dealt(needed, clock.by, n))
    if block is not None:
        keyed, clock = spread(keyed, clock, block, max(durations.lag, durations.short, durations.medium, durations.long), durations.horizon)
        keyed = dealt(keyed, clock.by, n)
    rows = with_energy(keyed, durations, clock, tolerance)
    rolled = with_rolling(rows, clock, rolling_columns(durations))
    ahead = asof("battery_soc_pct", clock.after(durations.horizon), durations.horizon, tolerance)
    c = F.col
    built = rolled.select(
        DEVICE,
        TIME,
        "discharge_rate_wh",
        "soc_delta_5min",
        "cell_imbalance",
        (c("battery_temp_c") - c("rolling_temp_mean_7d")).alias("temp_deviation"),
        (c("battery_usable_ah") * c("battery_soh_pct") / 100.0).alias("soh_adjusted_cap"),
        F.try_divide("capacity_charge_ah", "battery_usable_ah").alias("charge_headroom"),
        (c("gps_speed_kmh") * c("battery_soc_pct")).alias("speed_x_soc"),
        *[c(n) for n in FEATURES if n.startswith("rolling_")],
        F.when(F.coalesce("gps_speed_kmh", F.lit(0.0)) <= 0, c("discharge_rate_wh")).otherwise(0.0).alias("idle_drain"),
        ahead.alias(TARGET),
        *clock.tie,
        *([PART, OWN] if clock.split else []),
    )
    built = gathered(built) if clock.split else built
    return built.where(c(TARGET).isNotNull()).select(DEVICE, TIME, *FEATURES, TARGET, *clock.tie)


def with_split(df: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Adds is_test (int): of each device the rows at or after the time of row floor(share * (n - 1))."""
    order, device = Window.partitionBy(DEVICE).orderBy(TIME), Window.partitionBy(DEVICE)
    n, rn = F.count("*").over(device), F.row_number().over(order)
    up, down = share
    placed = df.select("*", (rn - 1 == F.floor((n - 1) * up / down)).alias("__cut"))
    cut = F.max(F.when(F.col("__cut"), F.col(TIME))).over(device)
    return placed.select(*df.columns, (F.col(TIME) >= cut).cast("int").alias("is_test"))


def _role(i: Column, m: Column, f: Column | int, k: int) -> Column:
    """train, valid or null: what row i of a device's m rows does in fold f of k."""
    f = F.lit(f) if isinstance(f, int) else f
    part = lambda j: F.floor((f + j) * m / (k + 1))
    start = F.greatest(F.least(part(1), m - 2), F.lit(1))
    end = F.greatest(F.least(part(2), m - 1), start + 1)
    return F.when(m < 5, None).when(i <= start, "train").when(i <= end, "valid")


def folds(df: DataFrame, k: int = 3, clock: Clock = PLAIN) -> DataFrame:
    """(fold, role, and the row): expanding time folds of each device; role is train or valid.

    Fold f trains on a device's first rows and validates on the part after; devices of fewer than five rows
    are left out.
    """
    order, device = Window.partitionBy(DEVICE).orderBy(TIME, *clock.tie), Window.partitionBy(DEVICE)
    rows = df.select("*", F.row_number().over(order).alias("__i"), F.count("*").over(device).alias("__m"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    role = _role(F.col("__i"), F.col("__m"), F.col("fold"), k)
    return spread.select("fold", role.alias("role"), *df.columns).where("role is not null")


def with_roles(df: DataFrame, k: int = 3, clock: Clock = PLAIN) -> DataFrame:
    """Adds roles: for each of k folds 1 where the row trains, 2 where it validates, else 0. The rows stay as many as they are."""
    order, device = Window.partitionBy(DEVICE).orderBy(TIME, *clock.tie), Window.partitionBy(DEVICE)
    i, m = F.row_number().over(order), F.count("*").over(device)
    number = lambda f: F.coalesce(F.when(_role(i, m, f, k) == "train", 1).when(_role(i, m, f, k) == "valid", 2), F.lit(0))
    return df.select("*", F.array(*[number(f) for f in range(k)]).alias("roles"))


def sequences(df: DataFrame, features: tuple[str, ...] = FEATURES, length: int = 10, clock: Clock = PLAIN) -> DataFrame:
    """(device, ts, sequence, target): the last ``length`` rows' features of every row that has so many."""
    order = Window.partitionBy(DEVICE).orderBy(TIME, *clock.tie)
    recent = order.rowsBetween(1 - length, 0)
    rows = df.select(DEVICE, TIME, TARGET, *clock.tie, F.array(*[F.col(c).cast("double") for c in features]).alias("__x"))
    listed = rows.select(DEVICE, TIME, F.collect_list("__x").over(recent).alias("sequence"), TARGET, *clock.tie, F.row_number().over(order).alias("__nth"))
    return listed.where(F.col("__nth") >= length).drop("__nth")


def with_validation(seqs: DataFrame, percent: int = 15, least: int = 10) -> DataFrame:
    """Adds is_valid (int): the last ceil(percent) of a device's sequences if it has ``least``.

    If no device has so many, the last tenth of all, by time; the times are searched only then.
    """
    device = Window.partitionBy(DEVICE)
    n = F.count("*").over(device)
    back = n + 1 - F.row_number().over(device.orderBy(TIME))  # in the order that sequences have: nothing is sorted again
    marked = seqs.select("*", ((n >= least) & (back <= F.ceil(n * percent / 100.0))).alias("__tail"))
    tail = F.col("__tail")
    if seqs.groupBy(DEVICE).count().where(F.col("count") >= least).isEmpty():
        late = exact_quantiles(seqs, {TIME: F.unix_micros(TIME)}, (0.9,))[TIME][0]
        tail = tail | (F.unix_micros(TIME) >= F.lit(late))
    return marked.select(*seqs.columns, tail.cast("int").alias("is_valid"))


def standardised(train: DataFrame, rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The rows with their features filled by the training medians (all null: 0) and scaled by mean and population deviation."""
    usable = lambda c: F.when(F.abs(c) < float("inf"), F.nanvl(F.col(c), F.lit(None).cast("double")))
    held = train.select(*[usable(c).cast("double").alias(c) for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        medians = {c: found[0] or 0.0 for c, found in exact_quantiles(held, {c: F.col(c) for c in features}, (0.5,), kept=True).items()}
        filled = {c: F.coalesce(usable(c), F.lit(medians[c])) for c in features}
        scale = held.agg(*[f(F.coalesce(c, F.lit(medians[c]))).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()
    finally:
        held.unpersist()
    scaled = lambda c: (filled[c] - F.lit(scale[f"mean_{c}"])) / F.lit(scale[f"dev_{c}"] or 1.0)
    return rows.select(*[scaled(c).alias(c) if c in features else F.col(c) for c in rows.columns])


def regression_metrics(df: DataFrame, actual: str | Column, predicted: str | Column) -> DataFrame:
    """(n, rmse, mae, r2) in one pass."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    pairs = df.select(a.alias("a"), p.alias("p")).where("a is not null and p is not null")
    sums = pairs.agg(
        F.count("*").alias("n"),
        F.avg(F.pow(F.col("a") - F.col("p"), F.lit(2))).alias("mse"),
        F.avg(F.abs(F.col("a") - F.col("p"))).alias("mae"),
        F.var_pop("a").alias("var"),
    )
    return sums.select("n", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "var")).alias("r2"))
