"""Raw messages to canonical telemetry: one lazy projection over a CSV scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ampflow.schema import (
    BATTERY_FIELDS,
    COLUMN_TIMES,
    COLUMNS,
    GPS_FIELDS,
    MESSAGE,
    NUMERIC_COLUMNS,
    PAYLOAD_TIMES,
    ROOT_TIMES,
)

INGEST_SEQ = "ingest_seq"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The CSV as text columns; a payload may hold line ends and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def numbered(df: DataFrame, name: str = INGEST_SEQ) -> DataFrame:
    """Adds the order of ingestion: rows of a file by their place, files in the order in which Spark deals them.

    Take it right after reading and write it with the rows; a later job would number them anew.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def payload_column(df: DataFrame) -> str:
    """``payload`` itself, else the one column of that name in another case."""
    if "payload" in df.columns:
        return "payload"
    for name in df.columns:
        if name.strip().lower() == "payload":
            return name
    raise ValueError("no payload column")


def pseudonym(value: Column, salt: str) -> Column:
    """Salted SHA-256 in hex; null stays null."""
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def parsed_time(value: Column) -> Column:
    """Numbers above 1e12 are milliseconds, above 1e9 seconds; other texts ISO; null where nothing fits.

    A JSON number at or below 1e9 counts as seconds as well, but in text form it cannot be told from one in
    quotes; it is read as seconds.
    """
    text = F.trim(value)
    number = text.try_cast("double")
    return (
        F.when(number > 1e12, F.timestamp_micros(F.round(number * 1000).cast("long")))
        .when(number.isNotNull() & ~F.isnan(number), F.timestamp_micros(F.round(number * 1e6).cast("long")))
        .otherwise(F.try_to_timestamp(text))
    )


def canonical(df: DataFrame, salt: str = "", keep: tuple[str, ...] = (), counts: Observation | None = None) -> DataFrame:
    """The 21 columns of every message that has an identifier, and the columns to keep.

    A message that is no JSON object has none, and neither has one whose payload is no object; both
    go. A value that is no number becomes null; so does a NaN. counts: told n_read and n_skipped by the next action.
    """
    column = payload_column(df)
    m = F.from_json(F.col(f"`{column}`"), MESSAGE)
    rows = df.select("*", m.alias("__m"))
    p = F.col("__m.payload")
    times = [
        *[F.col(f"__m.{c}") for c in ROOT_TIMES],
        *[p[c] for c in PAYLOAD_TIMES],
        *[F.col(f"`{c}`").cast("string") for c in COLUMN_TIMES if c in df.columns],
    ]
    values = {
        "device_id": pseudonym(F.coalesce(p["deviceId"], p["imei"]), salt),
        "imei_token": pseudonym(p["imei"], salt),
        "last_ping_time": parsed_time(p["lastPingTime"]),
        "device_status": p["status"],
        **{c: p["gps"][f] for c, f in GPS_FIELDS.items()},
        **{c: p["battery"][f] for c, f in BATTERY_FIELDS.items()},
        "ts": parsed_time(F.coalesce(*times)),
    }
    for c in NUMERIC_COLUMNS:
        number = values[c].try_cast("double")
        values[c] = F.when(~F.isnan(number), number)
    known = F.coalesce(p["deviceId"], p["imei"]).isNotNull()
    if counts is not None:
        rows = rows.observe(counts, F.count("*").alias("n_read"), F.count_if(~known).alias("n_skipped"))
    return rows.where(known).select(*[values[c].alias(c) for c in COLUMNS], *keep)


def enforced(df: DataFrame) -> DataFrame:
    """The canonical columns in order and type; missing ones are null."""
    from ampflow.schema import CANONICAL

    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in CANONICAL
        ]
    )
