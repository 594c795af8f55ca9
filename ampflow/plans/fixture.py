"""Telemetry derived from the ``events`` table: the same rows in Spark and, as SQL, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.schema import COLUMNS, DAY, HOUR, SECOND, Durations, TripRules

SALT = "fixture"

#: The events are hours apart, so durations are longer than the fleet's.
DURATIONS = Durations(
    lag=DAY, horizon=2 * DAY, short=2 * DAY, medium=7 * DAY, long=7 * DAY, delayed=DAY, near_duplicate=HOUR, jump=12 * HOUR
)
TRIPS = TripRules(stop_us=12 * HOUR)
#: Parts of the durations that the SQL needs, in seconds.
IN_SECONDS = {k: v // SECOND for k, v in vars(DURATIONS).items()}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical columns for every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    k, number = F.col("k"), F.col("event_id")
    place = 0.01 * F.floor((F.dayofmonth("ts") - 1) / 5)
    fix = lambda at: F.when(number % 53 == 0, None).when(number % 97 == 0, 0.0).otherwise(at + place)
    columns = {
        "device_id": F.sha2(F.concat("user", F.lit(SALT)), 256),
        "imei_token": F.sha2(F.concat(F.lit("imei-"), "user", F.lit(SALT)), 256),
        "last_ping_time": F.col("ts"),
        "device_status": F.when(number % 10 == 0, "Inactive").otherwise("Active"),
        "gps_lat": fix(11.0),
        "gps_lon": fix(76.9),
        "gps_speed_kmh": F.when(F.col("event_type") == "signup", 0.0).otherwise(F.least("value", F.lit(120.0))),
        "gps_delta_km": F.col("value") / 100,
        "gps_total_km": 1000 + number / 10,
        "battery_state": F.when(F.col("event_type") == "error", "Charging").otherwise("Discharging"),
        "battery_soc_pct": (k + F.when(number % 101 == 0, 50).otherwise(0)).cast("double"),
        "battery_capacity_ah": F.lit(40.0),
        "battery_usable_ah": (20 + k % 5).cast("double"),
        "capacity_discharge_ah": (10 + k % 6).cast("double"),
        "capacity_charge_ah": (5 + k % 8).cast("double"),
        "battery_voltage_v": (48 + k % 10).cast("double"),
        "cell_voltage_min": F.lit(3.2) - F.lit(0.01) * (k % 7),
        "cell_voltage_max": F.lit(3.2) + F.lit(0.01) * (k % 11),
        "battery_temp_c": (25 + k % 20).cast("double"),
        "battery_soh_pct": (100 - k % 3).cast("double"),
        "ts": F.col("ts"),
    }
    return e.select(*[columns[c].alias(c) for c in COLUMNS])


#: The same as a common table expression ``t``.
TELEMETRY_SQL = f"""e AS (
  SELECT event_id, ts, user_id::VARCHAR AS usr, event_type, value,
         regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k,
         0.01::DOUBLE * ((day(ts) - 1) // 5) AS place
  FROM events
), t AS (
  SELECT sha256(usr || '{SALT}') AS device_id, sha256('imei-' || usr || '{SALT}') AS imei_token, ts AS last_ping_time,
         CASE WHEN event_id % 10 = 0 THEN 'Inactive' ELSE 'Active' END AS device_status,
         CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE 11.0::DOUBLE + place END AS gps_lat,
         CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE 76.9::DOUBLE + place END AS gps_lon,
         CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE least(value, 120.0::DOUBLE) END AS gps_speed_kmh,
         value / 100::DOUBLE AS gps_delta_km, 1000 + event_id / 10::DOUBLE AS gps_total_km,
         CASE WHEN event_type = 'error' THEN 'Charging' ELSE 'Discharging' END AS battery_state,
         (k + CASE WHEN event_id % 101 = 0 THEN 50 ELSE 0 END)::DOUBLE AS battery_soc_pct,
         40.0::DOUBLE AS battery_capacity_ah, (20 + k % 5)::DOUBLE AS battery_usable_ah,
         (10 + k % 6)::DOUBLE AS capacity_discharge_ah, (5 + k % 8)::DOUBLE AS capacity_charge_ah,
         (48 + k % 10)::DOUBLE AS battery_voltage_v,
         3.2::DOUBLE - 0.01::DOUBLE * (k % 7) AS cell_voltage_min, 3.2::DOUBLE + 0.01::DOUBLE * (k % 11) AS cell_voltage_max,
         (25 + k % 20)::DOUBLE AS battery_temp_c, (100 - k % 3)::DOUBLE AS battery_soh_pct, ts, epoch_us(ts) AS us
  FROM e
)"""
