"""The telemetry data model: message payload, canonical columns, defaults of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names of the message's fields.
GPS_FIELDS = {
    "gps_lat": "gpsLatitude",
    "gps_lon": "gpsLongitude",
    "gps_speed_kmh": "gpsGroundSpeed",
    "gps_delta_km": "gpsGroundDeltaDistance",
    "gps_total_km": "gpsTotalGroundDistance",
}
BATTERY_FIELDS = {
    "battery_state": "batteryState",
    "battery_soc_pct": "batterySoc",
    "battery_capacity_ah": "batteryInstalledCapacity",
    "battery_usable_ah": "batteryUsableCapacity",
    "capacity_discharge_ah": "batteryCapacityToDischarge",
    "capacity_charge_ah": "batteryCapacityToCharge",
    "battery_voltage_v": "batteryVoltage",
    "cell_voltage_min": "batteryMinCellVoltage",
    "cell_voltage_max": "batteryMaxCellVoltage",
    "battery_temp_c": "batteryAvgTemp",
    "battery_soh_pct": "batterySoh",
}
ROOT_TIMES = ("timestamp", "ts", "created_timestamp", "createdTimestamp")
PAYLOAD_TIMES = ("timestamp", "ts", "time", "created_timestamp", "createdTimestamp", "lastPingTime")
COLUMN_TIMES = ("timestamp", "created_timestamp", "ts")


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Every leaf is text, so that numbers in quotes survive; the canonical schema casts afterwards.
MESSAGE = _strings(ROOT_TIMES).add(
    "payload",
    _strings(dict.fromkeys(["deviceId", "imei", "status", "lastPingTime", *PAYLOAD_TIMES]))
    .add("gps", _strings(GPS_FIELDS.values()))
    .add("battery", _strings(BATTERY_FIELDS.values())),
)

TEXT_COLUMNS = ("device_id", "imei_token", "device_status", "battery_state")
TIME_COLUMNS = ("last_ping_time", "ts")
COLUMNS = (
    "device_id", "imei_token", "last_ping_time", "device_status", *GPS_FIELDS, *BATTERY_FIELDS, "ts",
)
NUMERIC_COLUMNS = tuple(c for c in COLUMNS if c not in TEXT_COLUMNS + TIME_COLUMNS)
CANONICAL = T.StructType(
    [
        T.StructField(
            c, T.StringType() if c in TEXT_COLUMNS else T.TimestampType() if c in TIME_COLUMNS else T.DoubleType()
        )
        for c in COLUMNS
    ]
)

# Columns whose null rate is reported when it is above CRITICAL_NULL_PCT.
CRITICAL_COLUMNS = ("battery_soc_pct", "battery_voltage_v", "gps_lat", "gps_lon")
CRITICAL_NULL_PCT = 5.0

FEATURES = (
    "discharge_rate_wh", "soc_delta_5min", "cell_imbalance", "temp_deviation", "soh_adjusted_cap", "charge_headroom",
    "speed_x_soc", "rolling_soc_std_1h", "rolling_speed_mean_5min", "rolling_temp_std_1h", "rolling_voltage_std_1h",
    "rolling_imbalance_mean_5min", "idle_drain",
)

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND


@dataclass(frozen=True)
class Durations:
    """Microseconds. The defaults are the fleet's; sparse data scales them."""

    lag: int = 5 * MINUTE
    horizon: int = 10 * MINUTE
    short: int = 5 * MINUTE
    medium: int = HOUR
    long: int = 7 * DAY
    delayed: int = MINUTE
    near_duplicate: int = SECOND
    jump: int = 30 * SECOND


@dataclass(frozen=True)
class TripRules:
    """When a trip starts and ends. A start needs a speed above what counts as standing."""

    start_speed_kmh: float = 2.0
    stop_speed_kmh: float = 0.0
    stop_us: int = 180 * SECOND
    least_km: float = 0.1

    def __post_init__(self) -> None:
        if self.stop_speed_kmh >= self.start_speed_kmh or self.stop_us <= 0:
            raise ValueError("a row could both start and end a trip under these rules")


@dataclass(frozen=True)
class Kalman:
    process: float = 1e-6
    measurement: float = 1e-4
    initial: float = 1.0
