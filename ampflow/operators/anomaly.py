"""Battery anomalies: four rules on one pass over the windowed rows, with an anomaly score as confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.operators.features import with_energy
from ampflow.operators.timeseries import DEVICE, PLAIN, TIME, Clock, Rolling, dealt, gathered, spread, with_rolling
from ampflow.schema import Durations

NEEDED = (
    DEVICE, TIME, "battery_soc_pct", "battery_usable_ah", "battery_voltage_v", "battery_temp_c", "battery_soh_pct",
    "cell_voltage_min", "cell_voltage_max",
)
SCORED = ("cell_imbalance", "battery_soh_pct", "battery_temp_c", "battery_soc_pct")


def prepared(df: DataFrame, durations: Durations = Durations(), clock: Clock = PLAIN, block: int | None = None) -> DataFrame:
    """The rows with what the rules compare: discharge and its mean size, the week's best health, the step in charge.

    block: microseconds; splits long devices over tasks (``timeseries.spread``).
    """
    needed = df.select(*NEEDED, *clock.tie, *[c for c in df.columns if c == "confidence"])
    keyed = clock.keyed(needed if block is not None else dealt(needed, clock.by, df.count()))
    if block is not None:
        # a mean of discharges reaches back over those, and each of them over its lag
        keyed, clock = spread(keyed, clock, block, max(durations.lag + durations.medium, durations.long))
    rows = with_energy(keyed, durations, clock)
    rolled = with_rolling(
        rows,
        clock,
        [
            Rolling("discharge_mean_abs", F.abs("discharge_rate_wh"), "avg", durations.medium, 5),
            Rolling("soh_max", F.col("battery_soh_pct"), "max", durations.long, 10),
        ],
    )
    step = F.abs(F.col("battery_soc_pct") - F.lag("battery_soc_pct").over(clock.window))
    done = rolled.select("*", F.coalesce(step, F.lit(0.0)).alias("soc_step"))
    return gathered(done) if clock.split else done


def discharge_spike() -> Column:
    mean = F.col("discharge_mean_abs")
    return F.coalesce((mean > 0) & (F.abs("discharge_rate_wh") > 3 * mean), F.lit(False))


def soh_dropped() -> Column:
    return F.coalesce(F.col("soh_max") - F.col("battery_soh_pct") > 1.0, F.lit(False))


def flags(rows: DataFrame, confidence: Column) -> DataFrame:
    """(device, ts, anomaly_type, confidence_score, carbon_credit_impact_pct): 0 to 4 for each prepared row."""
    base = F.least(F.lit(100.0), F.col("soc_step") * 0.3 + F.col("__confidence") * 25)
    over = (F.try_divide(F.abs("discharge_rate_wh"), F.col("discharge_mean_abs")) - 1) * 100
    spike = F.greatest(F.col("__base"), F.greatest(F.lit(0.0), F.least(over, F.lit(100.0))))
    rules = [
        ("cell_imbalance_high", F.col("cell_imbalance") > 0.05, F.lit(0.0)),
        ("soh_drop_7d", soh_dropped(), F.least(F.lit(25.0), F.col("__base"))),
        ("discharge_spike_vs_rolling", discharge_spike(), spike),
        ("temperature_spike", F.col("battery_temp_c") > 40, F.least(F.lit(50.0), F.col("__base"))),
    ]
    events = F.array(
        *[
            F.when(
                F.coalesce(applies, F.lit(False)),
                F.struct(
                    F.lit(name).alias("anomaly_type"),
                    F.round(F.col("__confidence"), 4).alias("confidence_score"),
                    F.round(impact, 2).alias("carbon_credit_impact_pct"),
                ),
            )
            for name, applies, impact in rules
        ]
    )
    scored = rows.select("*", confidence.alias("__confidence")).select("*", base.alias("__base"))
    found = scored.select(DEVICE, TIME, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return found.select(DEVICE, TIME, "e.*")
